"""attesta: traceable claims and corpus preparation as Spark plans."""
