"""rosterlab: event-level sports features, projections and roster checks on Spark."""
