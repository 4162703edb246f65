"""pointlake: a PySpark-native analytics engine for labelled LiDAR scans."""
