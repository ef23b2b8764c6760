"""tidewatch: flow-behaviour analytics as Spark DataFrame programs."""
