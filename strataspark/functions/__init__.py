"""strataspark.functions"""
