"""Weftgraph: a Spark-native engine that builds, enriches and analyses typed knowledge graphs."""
