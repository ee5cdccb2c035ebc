"""sessionlake: analytics over fleets of coding-agent transcripts, as PySpark DataFrame jobs."""
