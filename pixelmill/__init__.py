"""pixelmill: image-feature extraction and binary-classifier analytics on Spark.

Sub-packages: ``sources`` (scans and sinks), ``functions`` (Column
expressions and per-batch numpy kernels), ``operators`` (DataFrame
operators), ``plans`` (end-to-end jobs and the registered queries),
``streaming`` (Structured Streaming scoring).
"""

__version__ = "0.1.0"
