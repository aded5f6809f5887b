"""strataspark.plans"""
