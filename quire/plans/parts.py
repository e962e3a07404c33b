"""Pieces of SQL that several queries share."""

NO_BLOCKS = "counts AS (SELECT doc_id, count(*) FILTER (include AND type = 'heading') AS headings, count(*) FILTER (include AND type = 'text') AS paragraphs FROM blocks GROUP BY doc_id)"
WITH_NOTES = NO_BLOCKS + ", summary AS (SELECT counts.*, CASE WHEN include_notes THEN n ELSE 0 END AS notes FROM counts JOIN book_notes ON counts.doc_id = book_notes.doc_id)"
SECTION = "secs AS (SELECT *, sum(CAST(type = 'heading' AS INT)) OVER w - 1 + CAST(first_value(type) OVER w <> 'heading' AS INT) AS section FROM blocks WINDOW w AS (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING))"
CLAMP = "CAST(least({w}, greatest(1, floor(sqrt(8000000.0 * {a} / {b})))) AS BIGINT)"
