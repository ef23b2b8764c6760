from tidewatch.catalog import flows, keys, sources, context, calibration, metrics, activity, graph, stream  # noqa: F401
