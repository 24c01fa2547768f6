"""causeway: causal analytics over free text and structured cohorts, expressed as Spark plans."""
