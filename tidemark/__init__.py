"""tidemark: Spark-native analytics for operational time series.

Logs become one long metric frame, eleven detectors run over every series in
single partitioned plans, detections merge into graded events, and events that
overlap in time are related and explained.
"""

__version__ = "0.1.0"
