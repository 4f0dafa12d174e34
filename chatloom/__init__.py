"""chatloom: Spark-native processing of exported messaging-chat archives."""

__version__ = "0.1.0"
