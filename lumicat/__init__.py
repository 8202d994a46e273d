"""lumicat: a media-catalog engine on PySpark."""
