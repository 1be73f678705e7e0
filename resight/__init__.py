"""resight: longitudinal mark-recapture and growth analytics on PySpark DataFrames."""
