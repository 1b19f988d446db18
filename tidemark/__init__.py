"""tidemark: time-series preparation and analytics expressed as Spark DataFrame plans."""
