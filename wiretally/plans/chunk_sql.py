"""Check-engine text of the chunking chain: an independent, recursive formulation."""
from __future__ import annotations

from wiretally.functions.text import BLANKS
from wiretally.plans.recipes import BLOCKS, CAPTIONS

SPACE = "'" + BLANKS + "'"

# Prepared rows: text of 20 characters or more, large images; reading order.
PREPARED = BLOCKS + f""",
trimmed AS (SELECT * REPLACE (trim(content, {SPACE}) AS content) FROM blocks),
parts AS (SELECT *, string_split(content, chr(10)) AS ls FROM trimmed),
prepared AS (
  SELECT * EXCLUDE (block_type, ls),
    CASE WHEN block_type = 'image' THEN 'image'
      WHEN len(ls) >= 3 AND len(list_filter(ls, lambda x: contains(x, chr(9)) OR contains(x, '  |  ')
        OR length(x) - length(replace(x, '  ', '')) >= 6)) >= 0.4 * len(ls) THEN 'table'
      ELSE 'text' END AS block_type,
    CASE WHEN block_type = 'text' THEN length(content) END AS char_count,
    CASE WHEN block_type = 'text' THEN len(ls) END AS line_count
  FROM parts
  WHERE CASE WHEN block_type = 'image' THEN img_width * img_height >= 100000 ELSE length(content) >= 20 END),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY source_file ORDER BY page_number, y0, x0, block_no) - 1 AS block_index,
    count(*) OVER (PARTITION BY source_file) AS total_blocks FROM prepared),
ordered AS (
  SELECT *, round(block_index / greatest(total_blocks - 1, 1)::DOUBLE, 3) AS position_ratio FROM placed)"""

# Image rows get the caption text before merging.
ENRICHED = PREPARED + ",\n" + CAPTIONS + """,
enriched AS (
  SELECT o.* REPLACE (CASE WHEN o.block_type <> 'image' THEN o.content
      WHEN c.error IS NOT NULL THEN '[Image p.' || o.page_number || ' — non analysée : ' || c.error || ']'
      ELSE c.description
        || CASE WHEN c.key_elements <> '' THEN chr(10) || chr(10) || 'Éléments clés : ' || c.key_elements ELSE '' END
        || CASE WHEN c.technical_terms <> '' THEN chr(10) || chr(10) || 'Termes techniques : ' || c.technical_terms
           ELSE '' END END AS content),
    CASE WHEN o.block_type = 'image' AND c.error IS NULL THEN c.category END AS vision_category,
    CASE WHEN o.block_type = 'image' AND c.error IS NULL THEN c.confidence END AS vision_confidence,
    CASE WHEN o.block_type = 'image' THEN c.error END AS vision_error
  FROM ordered o LEFT JOIN caps c USING (source_file, block_no))"""

# Greedy merge as a recursion over the rows of each page.
MERGED = ENRICHED + f""",
paged AS (SELECT *, row_number() OVER (PARTITION BY source_file, page_number ORDER BY block_index) AS rn FROM enriched),
walk AS (
  SELECT source_file, page_number, rn, rn AS start_rn, block_index AS first_index, block_type AS kind, content AS body,
    x0, y0, x1, y1, position_ratio, char_count, FALSE AS merged
  FROM paged WHERE rn = 1
  UNION ALL
  SELECT n.source_file, n.page_number, n.rn,
    CASE WHEN joined THEN w.start_rn ELSE n.rn END, CASE WHEN joined THEN w.first_index ELSE n.block_index END,
    CASE WHEN joined THEN w.kind ELSE n.block_type END,
    CASE WHEN joined THEN w.body || chr(10) || n.content ELSE n.content END,
    CASE WHEN joined THEN w.x0 ELSE n.x0 END, CASE WHEN joined THEN w.y0 ELSE n.y0 END,
    CASE WHEN joined THEN greatest(w.x1, n.x1) ELSE n.x1 END, CASE WHEN joined THEN greatest(w.y1, n.y1) ELSE n.y1 END,
    n.position_ratio, n.char_count, joined
  FROM (SELECT w.*, p.rn AS next_rn,
          p.block_type <> 'image' AND w.kind <> 'image' AND length(w.body) < 80 AS joined
        FROM walk w JOIN paged p ON p.source_file = w.source_file AND p.page_number = w.page_number AND p.rn = w.rn + 1
       ) w
  JOIN paged n ON n.source_file = w.source_file AND n.page_number = w.page_number AND n.rn = w.next_rn),
merged AS (
  SELECT source_file, page_number, first_index AS block_index, kind AS block_type, body AS content, x0, y0, x1, y1,
    position_ratio, char_count AS block_char_count, merged
  FROM walk QUALIFY row_number() OVER (PARTITION BY source_file, page_number, start_rn ORDER BY rn DESC) = 1)"""


def split_sql(relation: str, keys: str) -> str:
    """Windows of 800 characters over rows of ``relation`` longer than that."""
    join = " AND ".join(f"m.{k} = c.{k}" for k in keys.split(", "))
    return f"""
long AS (SELECT {keys}, content, length(content) AS n FROM {relation}
         WHERE block_type = 'text' AND length(content) > 800),
cuts AS (
  SELECT {keys}, 0::BIGINT AS s,
    CASE WHEN 800 < n AND strpos(reverse(substring(content, 701, 100)), chr(10)) > 0
      THEN 800 - strpos(reverse(substring(content, 701, 100)), chr(10)) ELSE 800 END AS e, n, content
  FROM long
  UNION ALL
  SELECT {keys}, e - 150,
    CASE WHEN e + 650 < n AND strpos(reverse(substring(content, e + 551, 100)), chr(10)) > 0
      THEN e + 650 - strpos(reverse(substring(content, e + 551, 100)), chr(10)) ELSE e + 650 END, n, content
  FROM cuts WHERE e - 150 < n),
kept AS (
  SELECT {keys}, s AS split_start, least(e, n) AS split_end, trim(substring(content, s + 1, e - s), {SPACE}) AS piece
  FROM cuts WHERE s < n AND length(trim(substring(content, s + 1, e - s), {SPACE})) > 0),
windows AS (
  SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY split_start) - 1 AS split_part,
    count(*) OVER (PARTITION BY {keys}) AS split_total FROM kept),
pieces AS (
  SELECT m.* REPLACE (trim(coalesce(c.piece, m.content), {SPACE}) AS content),
    c.split_part, c.split_total, c.split_start, c.split_end
  FROM {relation} m LEFT JOIN windows c ON {join})"""


def heading_sql(x: str) -> str:
    return (
        f"regexp_matches({x}, '(?im)^(Lab\\s+\\d|Step\\s+\\d|Figure\\s+\\d|Section\\s+\\d|Chapter\\s+\\d|"
        f"\\d+\\.\\d+\\s+[A-Z])')"
    )


def type_sql(kind: str, x: str) -> str:
    cli = (
        r"(?i)\[[\w\-]+\]|<[\w\-]+>|display |interface |vlan |ospf |ip route|undo |system-view|"
        r"GigabitEthernet|Eth-Trunk|Vlanif"
    )
    return (
        f"CASE WHEN {kind} = 'image' THEN 'image_desc' WHEN {kind} = 'table' THEN 'table' "
        f"WHEN length({x}) < 120 AND {heading_sql(x)} THEN 'heading' "
        f"WHEN len(regexp_extract_all({x}, '{cli}')) >= 2 AND len(string_split({x}, chr(10))) >= 3 THEN 'code_cli' "
        f"ELSE 'text' END"
    )


def chunks_sql(relation: str = "merged") -> str:
    """From merged rows to final chunks."""
    return split_sql(relation, "source_file, block_index") + f""",
typed AS (
  SELECT *, row_number() OVER (PARTITION BY source_file ORDER BY page_number, block_index, split_part) - 1
      AS chunk_index,
    count(*) OVER (PARTITION BY source_file) AS total_chunks, {type_sql('block_type', 'content')} AS chunk_type,
    CASE WHEN {heading_sql('content')} AND length(content) < 150
      THEN trim(string_split(content, chr(10))[1], {SPACE}) END AS mark
  FROM pieces),
titled AS (
  SELECT *, coalesce(last_value(mark IGNORE NULLS) OVER (PARTITION BY source_file ORDER BY chunk_index
      ROWS BETWEEN 19 PRECEDING AND 1 PRECEDING), '') AS section_title,
    lag(chunk_type) OVER d AS pt, lag(content) OVER d AS pc, lead(chunk_type) OVER d AS nt, lead(content) OVER d AS nc
  FROM typed WINDOW d AS (PARTITION BY source_file ORDER BY chunk_index)),
chunks AS (
  SELECT *,
    CASE WHEN chunk_type IN ('text', 'code_cli') AND pt IN ('text', 'code_cli')
      THEN CASE WHEN length(pc) > 150 THEN trim(right(pc, 150), {SPACE}) ELSE pc END ELSE '' END AS overlap_prev,
    CASE WHEN chunk_type IN ('text', 'code_cli') AND nt IN ('text', 'code_cli')
      THEN CASE WHEN length(nc) > 150 THEN trim(left(nc, 150), {SPACE}) ELSE nc END ELSE '' END AS overlap_next,
    sha256(source_file || '|' || chunk_index || '|' || content) AS chunk_id
  FROM titled)"""


CHUNKS = "WITH RECURSIVE " + MERGED + ", " + chunks_sql()
EMBEDDING_TEXT = """
  CASE WHEN section_title <> '' THEN 'Section: ' || section_title || chr(10) ELSE '' END
  || CASE WHEN chunk_type IN ('code_cli', 'table') THEN 'Type: ' || chunk_type || chr(10) ELSE '' END
  || CASE WHEN overlap_prev <> '' THEN '[contexte précédent]: ' || overlap_prev || chr(10) ELSE '' END || content"""
