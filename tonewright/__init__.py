"""Tonewright: sentiment work on business and finance text as Spark DataFrame jobs."""
