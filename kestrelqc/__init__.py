"""Quality control of observations on Spark, and (in ``llm``) training-data operators."""
