"""assetgraph: event-sourced asset-graph analytics as Spark DataFrame jobs."""
