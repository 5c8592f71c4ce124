"""Headline queries on $BENCH_SF_DIR with local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path
from statistics import median

sys.path.insert(0, str(Path(__file__).resolve().parent))
from rosterlab.plans import QUERIES  # noqa: E402
from rosterlab.session import get_spark  # noqa: E402

HEADLINE = [
    "A01_game_level_rules", "D01_batter_rolling", "D02_platoon", "D08_team_offense", "D13_batter_feature_matrix",
    "D15_pitcher_rolling", "D17_ip_features", "D18_era_features", "D21_pitcher_feature_matrix", "D33_availability",
    "D37_qualifying_slates", "D41_resolve_players", "D50_project_slate", "D59_normalise_ownership",
    "D61_selection_frequency", "D63_dedupe_lineups", "D64_score_lineups", "D65_exposure_select",
    "D67_overlap_with_portfolio", "D68_validate_lineups", "D69_export_safety", "D70_domain_checks", "D80_train_quantiles",
    "D83_backtest", "D94_pre_slate_report", "S16_extract_from_html", "T01_incremental_append", "T06_daily_counters_stream",
    "W04_lagged_team_means", "W07_trailing_era",
]


#: Queries over so many seconds are run once, others three times.
LONG = 5.0


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = get_spark("bench", os.environ.get("BENCH_CPUS", "8"))
    spark.sparkContext.setLogLevel("ERROR")
    only = sys.argv[1:]
    names = [n for n in HEADLINE if not only or any(n.startswith(o) for o in only)]

    def seconds(name: str) -> float:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    for name in names[:3]:  # the JVM starts and compiles outside the figures
        seconds(name)
    times: dict[str, float] = {}
    for name in names:
        runs = [seconds(name)]
        if runs[0] < LONG:
            runs += [seconds(name), seconds(name)]
        times[name] = round(median(runs), 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": Path(folder).name.removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
