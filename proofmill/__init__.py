"""Part of proofmill, an evidence-checking analytics library on Spark."""
