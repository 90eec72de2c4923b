"""Repository history analytics on Spark: ownership, risk, history, reach, intervals and identity."""
