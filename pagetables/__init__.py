"""Page tables on Spark: web pages in, typed element, text and JSON-LD tables out."""
