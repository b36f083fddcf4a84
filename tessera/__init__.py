"""tessera: fine-tuning data preparation and bulk inference as Spark jobs."""

__version__ = "0.1.0"
