"""textloom: web pages and plain text to speakable reading plans, on Spark."""
