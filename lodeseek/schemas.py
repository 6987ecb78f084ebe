"""Schemas of the index tables and of the records that come in."""

PAGE_MESSAGE = "url string, html string, title string, outgoing_links array<string>, image_map map<string,string>"
IDX_PAGES = "page_id long, url string, title string, heading string, embedding array<float>, doc_length int, crawled_at timestamp_ntz"
TERMS = "term string, df long"
VOCAB = "word string, stem string"
POSTINGS = "term string, page_id long, tf float"
IMAGES = "image_id long, url string, alt_text string, url_hash string, embedding array<float>"
LINKS = "from_page_id long, to_page_id long"
METADATA = "total_documents long, avg_doc_length double"
METRICS = "metricType string, timestamp string, text string, duration_ms int"
TABLES = {"idx_pages": IDX_PAGES, "terms": TERMS, "vocab": VOCAB, "postings": POSTINGS, "images": IMAGES, "links": LINKS, "metadata": METADATA}


def create_tables(spark, database: str = "default") -> None:
    """Creates the tables that don't exist yet."""
    for name, columns in TABLES.items():
        spark.sql(f"CREATE TABLE IF NOT EXISTS {database}.{name} ({columns.replace('timestamp_ntz', 'TIMESTAMP_NTZ')}) USING parquet")
