"""trialweave: event-locked trial analytics as Spark DataFrame jobs."""
