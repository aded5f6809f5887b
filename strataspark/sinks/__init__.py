"""strataspark.sinks"""
