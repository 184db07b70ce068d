"""Telemetry rollups and queries over DataFrames, with a training-data toolkit in ``tidewell.llm``."""
