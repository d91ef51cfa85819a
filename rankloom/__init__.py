"""Survey measurement, linkage and denoising operators for Spark."""
