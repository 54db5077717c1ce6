"""tankline: fleet-fuel purchasing analytics as Spark DataFrame functions."""
