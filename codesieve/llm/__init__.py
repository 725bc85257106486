"""Operators of a training-data pipeline, each over whole tables; :mod:`codesieve.llm.queries` registers them."""
