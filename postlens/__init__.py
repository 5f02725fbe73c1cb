"""postlens: content-evidence analytics and training-data operators on Spark."""
