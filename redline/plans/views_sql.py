"""DuckDB twins of ``redline.sources.views`` for the oracle SQL.

``with_views(sql, names...)`` prefixes a query with the CTEs it uses.
"""

from __future__ import annotations

VIEWS = {
    "contract_files": """
SELECT CAST(doc_id AS VARCHAR) AS id, doc_id,
       source || '_' || CAST(doc_id AS VARCHAR) ||
         CASE (doc_id // 3) % 4 WHEN 0 THEN '.pdf' WHEN 1 THEN '.PDF' WHEN 2 THEN '.docx' ELSE '.txt' END AS filename,
       CAST(strlen(text) AS BIGINT) AS size_bytes,
       text AS extracted_text, source AS project, lang,
       CASE (doc_id // 3) % 4 WHEN 0 THEN 'purchase_agreement' WHEN 1 THEN 'rider'
                       WHEN 3 THEN 'legal_comments' END AS document_type,
       TIMESTAMP '2024-01-01 00:00:00' + to_minutes(CAST(doc_id AS BIGINT)) AS uploaded_at,
       (doc_id // 3) % 4 <> 3 AS processed
FROM documents""",
    "law_firms": """
SELECT 'firm_' || CAST(firm_rank AS VARCHAR) AS id, 'Firm ' || CAST(firm_rank AS VARCHAR) AS name,
       keywords, TIMESTAMP '2024-01-01 00:00:00' + to_days(firm_rank) AS created_at, firm_rank
FROM (SELECT CAST(item_id // 5 AS INTEGER) AS firm_rank,
             list(text ORDER BY item_id) AS keywords
      FROM benchmark GROUP BY 1)""",
    "contract_templates": """
SELECT 'tpl_' || CAST(item_id AS VARCHAR) AS id,
       'firm_' || CAST(item_id // 5 AS VARCHAR) AS law_firm_id,
       'Firm ' || CAST(item_id // 5 AS VARCHAR) AS law_firm_name,
       CASE item_id % 3 WHEN 0 THEN 'purchase_agreement' WHEN 1 THEN 'rider' ELSE 'legal_comments' END
         AS template_type,
       'template_' || CAST(item_id AS VARCHAR) || '.docx' AS file_name,
       text AS content,
       TIMESTAMP '2024-01-01 00:00:00' + to_hours(CAST(item_id AS BIGINT)) AS created_at
FROM benchmark""",
    "sectioned_docs": """
SELECT doc_id, source AS project,
       array_to_string(list_transform(list_filter(string_split(translate(text, chr(10), ' '), '.'), lambda s: trim(s) <> ''),
         lambda s, i: CAST((i - 1) // 10 % 5 + 1 AS VARCHAR) || '.' || CAST((i - 1) % 10 + 1 AS VARCHAR) || ' ' || s), chr(10)) AS text
FROM documents""",
    "comment_docs": """
SELECT conv_id AS project_id,
       string_agg(CASE WHEN turn % 3 = 2 THEN 'Section 1.' || CAST(turn AS VARCHAR) || ': ' || text
                       ELSE text END, chr(10) ORDER BY turn) AS text
FROM conversations GROUP BY conv_id""",
    "chat": """
SELECT conv_id AS line_no,
       list({'role': role, 'content': text} ORDER BY turn) AS messages
FROM conversations GROUP BY conv_id""",
    "reviews": """
SELECT 'rev_' || CAST(event_id AS VARCHAR) AS id, event_id,
       ['contract_' || CAST(user_id AS VARCHAR) || '.pdf',
        'annex_' || CAST(event_id % 7 AS VARCHAR) || '.docx'] AS contract_files,
       'model_' || CAST(user_id % 3 AS VARCHAR) AS model_id,
       'Firm ' || CAST(user_id % 8 AS VARCHAR) AS law_firm_name,
       CASE event_type WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed'
                       ELSE 'processing' END AS status,
       ts AS created_at,
       CASE WHEN event_type IN ('purchase', 'error')
            THEN ts + to_microseconds(CAST(round(value * 1000000) AS BIGINT)) END AS completed_at,
       CASE WHEN event_type IN ('purchase', 'error') THEN value END AS processing_time
FROM events""",
    "review_comments": """
SELECT 'cmt_' || CAST(event_id AS VARCHAR) AS id, event_id,
       CAST(user_id AS VARCHAR) AS contract_file_id,
       'firm_' || CAST(user_id % 8 AS VARCHAR) AS law_firm_id,
       CASE event_type WHEN 'click' THEN 'completed' WHEN 'error' THEN 'failed'
                       ELSE 'processing' END AS status,
       ts AS created_at, value AS processing_time
FROM events""",
    "loss_log": """
SELECT 'job_' || CAST(user_id AS VARCHAR) AS job_id, event_id AS step, 'loss' AS metric,
       value / 100 AS value, ts,
       CASE event_type WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed'
                       ELSE 'processing' END AS status
FROM events""",
    "review_docs": """
SELECT coalesce(d.source, 'unassigned') AS project, c.project_id AS review_id, c.text
FROM comment_docs c LEFT JOIN documents d ON c.project_id - c.project_id % 4 % 3 = d.doc_id""",
}


def with_views(sql: str, *names: str) -> str:
    ctes = ",\n".join(f"{n} AS ({VIEWS[n]})" for n in names)
    return f"WITH {ctes}\n{sql}" if names else sql
