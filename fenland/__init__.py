"""Channel-network extraction and morphometry for many sites on Spark."""
