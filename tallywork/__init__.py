"""tallywork: business-intelligence marts, KPIs, checks and scoring as Spark jobs."""
