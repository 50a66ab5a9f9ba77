"""A Spark-native engine for vehicle trajectories and road maps."""
