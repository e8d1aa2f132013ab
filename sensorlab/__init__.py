"""sensorlab: Spark-native operators for labelled machine-sensor data.

Every public operator takes a DataFrame and returns a DataFrame.  Nothing
is collected to the driver except documented, size-capped "fit" results
(category lists for one-hot encoding and pivots).
"""

__version__ = "0.1.0"
