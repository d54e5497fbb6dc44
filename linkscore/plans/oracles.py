"""SQL counterparts of the registered queries, for checking results with another engine.

The pages are taken apart with regular expressions that fit the generated markup, so these
statements share nothing with the element reader. Doubles are rounded to 6 places on both sides.
"""

from __future__ import annotations

from linkscore.functions import text as tx
from linkscore.functions import urls as ux
from linkscore.plans.queries import KEYWORD, KEYWORDS, LETTERS, TEXT_KEYWORD

_SPACES = "[" + tx.WHITESPACE + "]+"
_URL = r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)"


def _in(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


def _trim(x: str) -> str:
    return f"trim({x}, '{tx.WHITESPACE}')"


def _clean(x: str) -> str:
    notices = " OR ".join(f"contains(lower({x}), '{n}')" for n in tx.SCRIPT_NOTICES)
    return (
        f"CASE WHEN {x} IS NULL OR {x} = '' OR {notices} "
        f"OR lower({_trim(x)}) IN {_in(tx.BOILERPLATE_TEXTS)} THEN NULL ELSE {_trim(x)} END"
    )


def _tokens(x: str) -> str:
    return f"list_filter(string_split_regex({_trim(f'lower({x})')}, '{_SPACES}'), lambda t: t <> '')"


def _plain(x: str) -> str:
    """Text without the entities that the generated pages use; the last may lack its semicolon."""
    for entity, char in (
        ("quot", '"'), ("copy", "©"), ("middot", "·"), ("lt", "<"), ("gt", ">"), ("amp", "&"),
    ):
        x = f"regexp_replace({x}, '&{entity}(;|$)', '{char}', 'g')"
    return x


def _netloc(url: str) -> str:
    return f"regexp_extract({url}, '{_URL}', 2)"


def _path(url: str) -> str:
    return f"regexp_replace(regexp_extract({url}, '{_URL}', 3), ';[^/]*$', '')"


def _domain(url: str) -> str:
    domain = f"lower({_netloc(url)})"
    for affix in ux.DOMAIN_AFFIXES:
        domain = f"replace({domain}, '{affix}', '')"
    return f"nullif({domain}, '')"


def _path_words(url: str) -> str:
    keep = f"lambda w: w <> '' AND lower(w) NOT IN {_in(ux.GENERIC_PATH_WORDS)}"
    return f"list_filter(string_split_regex({_path(url)}, '[/-]'), {keep})"


_LINK = '<a href="([^"]*)">([^<]*)</a>'

# page_id, url, link_pos, href, text, title, previous_text, next_text, processed_text
LINKS = f"""
found AS (
  SELECT page_id, url,
         unnest(regexp_extract_all(html, '{_LINK}', 1)) AS raw_href,
         unnest(regexp_extract_all(html, '{_LINK}', 2)) AS raw_text,
         generate_subscripts(regexp_extract_all(html, '{_LINK}', 1), 1) AS link_pos,
         {_plain("regexp_extract(html, '<title>([^<]*)</title>', 1)")} AS raw_title,
         {_plain("regexp_extract(html, '<h1>([^<]*)</h1>', 1)")} AS raw_h1
  FROM pages),
decoded AS (
  SELECT page_id, url, link_pos, {_plain("raw_href")} AS href, {_plain("raw_text")} AS plain,
         raw_title, raw_h1
  FROM found),
context AS (
  SELECT page_id, url, link_pos, href, {_clean("plain")} AS text, {_clean("raw_title")} AS title,
         {_clean("plain")} AS previous_text,
         {_clean("coalesce(lead(plain) OVER (PARTITION BY page_id ORDER BY link_pos), raw_h1)")}
           AS next_text,
         {_domain("href")} AS domain, {_path_words("href")} AS path_words
  FROM decoded),
mentions AS (
  SELECT *, CASE WHEN row_number() OVER (PARTITION BY page_id, domain ORDER BY link_pos) = 1
            THEN domain END AS new_domain
  FROM context),
parts AS (
  SELECT *, list_concat(
    list_filter([text, title, new_domain], lambda p: p IS NOT NULL AND p <> ''), path_words,
    list_filter([previous_text, next_text], lambda p: p IS NOT NULL AND p <> '')) AS all_parts
  FROM mentions),
links AS (
  SELECT page_id, url, link_pos, href, text, title, previous_text, next_text,
         page_id::HUGEINT * 2147483648 + link_pos AS seq,
         CASE WHEN contains(href, 'http') THEN href ELSE url || href END AS href_url,
         array_to_string(
           list_filter(all_parts, lambda p, i: list_position(all_parts, p) = i), ' '
         ) AS processed_text
  FROM parts)"""

# links x keywords
ITEMS = f"""{LINKS},
items AS (
  SELECT links.*, k.keyword AS raw_keyword, lower(k.keyword) AS keyword, processed_text AS txt
  FROM links, (VALUES {", ".join(f"('{k}')" for k in KEYWORDS)}) AS k(keyword))"""


def _squash(x: str) -> str:
    return f"(1 / (1 + exp(-8 * {x})))"


# txt, keyword, exact, sim, context_text, context_sim, context_score, score; from items(txt, keyword)
# with a keyword of one token
SCORES = f"""
texts AS (SELECT DISTINCT txt, keyword FROM items),
tokenized AS (SELECT txt, keyword, {_tokens("txt")} AS tokens FROM texts),
frequencies AS (
  SELECT txt, keyword, token, count(*) AS n
  FROM (SELECT txt, keyword, unnest(tokens) AS token FROM tokenized)
  GROUP BY ALL),
norms AS (
  SELECT txt, keyword, sum(n * n)::DOUBLE AS norm2,
         sum(CASE WHEN token = keyword THEN n ELSE 0 END)::DOUBLE AS dot
  FROM frequencies GROUP BY ALL),
positions AS (
  SELECT *, len(tokens) - list_position(list_reverse(tokens), keyword) + 1 AS hit
  FROM tokenized WHERE list_contains(tokens, keyword)),
windows AS (
  SELECT txt, keyword, tokens[greatest(hit - 3, 1):hit + 3] AS window_tokens FROM positions),
window_sims AS (
  SELECT txt, keyword, array_to_string(window_tokens, ' ') AS context_text,
         len(list_filter(window_tokens, lambda t: t = keyword)) / sqrt(list_sum(list_transform(
           window_tokens, lambda t: len(list_filter(window_tokens, lambda u: u = t))))::DOUBLE)
         AS context_sim
  FROM windows),
similarities AS (
  SELECT t.txt, t.keyword,
         CASE WHEN contains(lower(t.txt), t.keyword) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS exact,
         coalesce(dot / sqrt(norm2), 0.0) AS sim, context_text, context_sim,
         coalesce({_squash("context_sim")}, 0.0) AS context_score
  FROM texts t LEFT JOIN norms USING (txt, keyword) LEFT JOIN window_sims USING (txt, keyword)),
scores AS (
  SELECT *, 1 / (1 + exp(-10 * (0.5 * exact + 0.3 * {_squash("sim")} + 0.2 * context_score - 0.6)))
         AS score
  FROM similarities)"""


def _letters(x: str) -> str:
    """Counts of some letters in a text, and a half."""
    counts = (f"length({x}) - length(replace({x}, '{c}', '')) + 0.5::DOUBLE" for c in LETTERS)
    return f"[{', '.join(counts)}]"


# As SCORES, with similarities of letter counts.
VECTOR_SCORES = f"""
texts AS (SELECT DISTINCT txt, keyword FROM items),
tokenized AS (SELECT txt, keyword, {_tokens("txt")} AS tokens FROM texts),
positions AS (
  SELECT *, len(tokens) - list_position(list_reverse(tokens), keyword) + 1 AS hit
  FROM tokenized WHERE list_contains(tokens, keyword)),
windows AS (
  SELECT txt, keyword, array_to_string(tokens[greatest(hit - 3, 1):hit + 3], ' ') AS context_text
  FROM positions),
similarities AS (
  SELECT txt, keyword, context_text,
         CASE WHEN contains(lower(txt), keyword) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS exact,
         list_cosine_similarity({_letters("txt")}, {_letters("keyword")}) AS sim,
         list_cosine_similarity({_letters("coalesce(context_text, '')")}, {_letters("keyword")}) AS context_sim
  FROM texts LEFT JOIN windows USING (txt, keyword)),
scores AS (
  SELECT *, 1 / (1 + exp(-10 * (0.5 * exact + 0.3 * {_squash("sim")} + 0.2 * CASE
         WHEN exact > 0 AND context_text IS NOT NULL THEN {_squash("context_sim")} ELSE 0.0 END - 0.6))) AS score
  FROM similarities)"""

SCORED_LINKS = f"""{ITEMS},
{SCORES},
scored AS (SELECT items.*, score FROM items JOIN scores USING (txt, keyword))"""

SCORED_DOCUMENTS = f"""
items AS (SELECT doc_id, text AS txt, '{KEYWORD}' AS keyword FROM documents),
{SCORES},
scored AS (SELECT doc_id, scores.* FROM items JOIN scores USING (txt, keyword))"""

_KEY_ID = r"sha256('=' || keyword || chr(31) || '=' || url || chr(31) || '=' || href_url)"

CATALOG = f"""{SCORED_LINKS},
catalog AS (
  SELECT {_KEY_ID} AS id, keyword, url AS source_url, href_url,
         round(score, 6) AS relevance_score, text AS raw_text
  FROM (SELECT *, row_number() OVER (PARTITION BY keyword, url, href_url ORDER BY seq DESC) AS n
        FROM scored)
  WHERE n = 1)"""

_HOST = "lower(regexp_extract(url, '^https?://([^/]+)', 1))"

ROBOTS = f"""
closed AS (
  SELECT {_HOST} AS host, min(regexp_extract(url, '^https?://[^/]+/([^/]*)', 1)) AS section
  FROM pages GROUP BY 1),
targets AS (
  SELECT page_id, url, regexp_replace(url, '^https?://[^/]+', '') AS target, section
  FROM pages JOIN closed ON host = {_HOST}),
decided AS (
  SELECT page_id, url, starts_with(target, '/' || section || '/9')
         OR NOT starts_with(target, '/' || section || '/') AS allowed
  FROM targets)"""

_BEST = """
best AS (
  SELECT url AS source_url, keyword, href_url, max(score) AS score, min(seq) AS first_seq
  FROM scored GROUP BY ALL),
ranked AS (
  SELECT *, row_number() OVER (
    PARTITION BY source_url, keyword ORDER BY score DESC, first_seq, href_url) AS rank
  FROM best)"""

_RANKED_COLUMNS = "source_url, keyword, href_url, round(score, 6) AS score, rank"
_ANALYSIS_COLUMNS = "seq::VARCHAR AS seq, keyword, url AS source_url, href_url, round(score, 6) AS score"
_FIRST_URL = "(SELECT min(url) FROM pages)"

_HOST_AS_WRITTEN = "regexp_extract(url, '^https?://([^/]+)', 1)"


def oracle_sql() -> dict[str, str]:
    return {
        "q_page_errors": """
            WITH p AS (
              SELECT CASE WHEN starts_with(url, 'https') THEN url END AS url,
                     CASE WHEN contains(url, '#') THEN '' ELSE html END AS html
              FROM pages)
            SELECT CASE WHEN url IS NULL THEN 'missing_url' ELSE 'empty_response' END AS error,
                   CASE WHEN url IS NULL THEN 'A page has no URL'
                        ELSE 'Nothing was received from ' || url END AS message,
                   url
            FROM p WHERE url IS NULL OR coalesce(html, '') = ''""",
        "q_robots": f"WITH {ROBOTS} SELECT page_id, url, allowed FROM decided",
        "q_queue_roundtrip": f"""
            WITH {ITEMS}
            SELECT seq::VARCHAR AS seq, raw_keyword AS keyword, href, text, previous_text, next_text,
                   title AS page_title, url AS source_url, processed_text
            FROM items""",
        "q_stream_score": f"WITH {SCORED_LINKS} SELECT {_ANALYSIS_COLUMNS} FROM scored",
        "q_stream_catalog": f"WITH {CATALOG} SELECT * FROM catalog",
        "q_first_link": f"""
            WITH {ITEMS}
            SELECT url AS source_url, raw_keyword AS keyword, href, text, link_pos, processed_text
            FROM items WHERE link_pos = 1""",
        "q_elements": f"""
            WITH tags AS (
              SELECT page_id, 'a' AS tag, unnest(regexp_extract_all(html, '{_LINK}', 2)) AS content
              FROM pages
              UNION ALL
              SELECT page_id, 'li',
                     unnest(regexp_extract_all(html, '<li><a[^>]*>([^<]*)</a></li>', 1))
              FROM pages
              UNION ALL
              SELECT page_id, 'h1', unnest(regexp_extract_all(html, '<h1>([^<]*)</h1>', 1))
              FROM pages
              UNION ALL
              SELECT page_id, 'title', unnest(regexp_extract_all(html, '<title>([^<]*)</title>', 1))
              FROM pages
              UNION ALL
              SELECT page_id, 'body', unnest(regexp_extract_all(html, '(<body>)', 0)) AS content
              FROM pages)
            SELECT page_id, tag, count(*) AS n,
                   sum(CASE WHEN tag = 'body' THEN 0 ELSE length({_plain("content")}) END)::BIGINT
                     AS n_chars
            FROM tags GROUP BY page_id, tag""",
        "q_links": f"""
            WITH {LINKS}
            SELECT page_id, link_pos, href, text, NULL::VARCHAR AS title,
                   NULL::VARCHAR AS aria_label, url AS source_url
            FROM links""",
        "q_metadata": f"""
            WITH cleaned AS (
              SELECT doc_id AS page_id, {_clean("' ' || source || ' '")} AS title,
                     {_clean("text")} AS description
              FROM documents)
            SELECT page_id, title,
                   CASE WHEN length(description) > 300 THEN substr(description, 1, 300) || '...'
                        WHEN length(description) > 10 THEN description END AS description
            FROM cleaned""",
        "q_link_rel": f"""
            SELECT doc_id AS page_id,
                   CASE WHEN lang IN ('en', 'de') THEN NULL
                        WHEN lang = 'fr' THEN 'noopener noreferrer'
                        ELSE 'me ' || source END AS rel,
                   md5({_clean("text")}) AS text_md5
            FROM documents""",
        "q_context": f"WITH {LINKS} SELECT page_id, link_pos, previous_text, next_text FROM links",
        "q_headings": f"""
            WITH {LINKS},
            menus AS (
              SELECT page_id, string_agg({_trim("text")}, '' ORDER BY link_pos) || 'end' AS menu
              FROM links GROUP BY page_id)
            SELECT page_id, link_pos, 'Menu' || menu || ' | ' || 'SiteMenu' || menu AS headings,
                   2::BIGINT AS n_headings
            FROM links JOIN menus USING (page_id)""",
        "q_clean_text": f"""
            SELECT doc_id, md5({_clean("text")}) AS cleaned_md5,
                   length({_clean("text")}) AS cleaned_chars
            FROM documents""",
        "q_url_parts": f"""
            SELECT page_id, {_netloc("url")} AS netloc, {_path("url")} AS path,
                   {_domain("url")} AS domain,
                   array_to_string({_path_words("url")}, ' ') AS path_words
            FROM pages""",
        "q_first_domain": "WITH "
        + LINKS.replace(
            f"{_plain('raw_href')} AS href",
            f"'https://www.' || {_HOST_AS_WRITTEN} || {_plain('raw_href')} AS href",
        )
        + " SELECT page_id, link_pos, href, processed_text FROM links",
        "q_processed_text": f"WITH {LINKS} SELECT page_id, link_pos, processed_text FROM links",
        "q_link_records": f"""
            WITH {ITEMS}
            SELECT href, raw_keyword AS keyword, text, NULL::VARCHAR AS title,
                   NULL::VARCHAR AS aria_label, NULL::VARCHAR AS rel, previous_text, next_text,
                   NULL::VARCHAR AS headings, items.title AS page_title,
                   NULL::VARCHAR AS page_description, url AS source_url, processed_text
            FROM items""",
        "q_url_tokens": f"""
            SELECT page_id, array_to_string(list_concat(
                     string_split({_netloc("url")}, '.'),
                     list_filter(string_split({_path("url")}, '/'), lambda s: s <> '')), ' '
                   ) AS tokens
            FROM pages""",
        "q_exact": f"""
            SELECT doc_id, CASE WHEN contains(lower(text), lower('{TEXT_KEYWORD}')) THEN 1.0::DOUBLE
                           ELSE 0.0::DOUBLE END AS exact
            FROM documents""",
        "q_semantic": f"""
            WITH tokenized AS (
              SELECT doc_id, unnest({_tokens("text")}) AS token FROM documents),
            frequencies AS (SELECT doc_id, token, count(*) AS n FROM tokenized GROUP BY ALL),
            sims AS (
              SELECT doc_id,
                     sum(CASE WHEN token IN {_in(TEXT_KEYWORD.lower().split())} THEN n ELSE 0 END)
                     / (sqrt(sum(n * n)::DOUBLE) * sqrt(2.0::DOUBLE)) AS sim
              FROM frequencies GROUP BY doc_id)
            SELECT doc_id, round(coalesce(sim, 0.0), 6) AS semantic_sim,
                   round({_squash("coalesce(sim, 0.0)")}, 6) AS semantic_score
            FROM documents LEFT JOIN sims USING (doc_id)""",
        "q_embed_cache": """
            WITH wanted AS (
              SELECT text FROM documents UNION ALL SELECT text FROM conversations)
            SELECT DISTINCT md5(text) AS text_key FROM wanted
            WHERE text IS NOT NULL
              AND md5(text) NOT IN (
                SELECT md5(text) FROM documents WHERE lang = 'en' AND text IS NOT NULL)""",
        "q_cosine": """
            WITH first AS (
              SELECT label, arg_min(embedding, vec_id) AS first_vector
              FROM embeddings GROUP BY label)
            SELECT vec_id, round(list_cosine_similarity(
                     embedding::DOUBLE[], first_vector::DOUBLE[]), 6) AS similarity
            FROM embeddings JOIN first USING (label)""",
        "q_tokens": f"""
            SELECT doc_id, len({_tokens("text")}) AS n_tokens,
                   md5(array_to_string({_tokens("text")}, chr(10))) AS tokens_md5
            FROM documents""",
        "q_context_window": f"""
            WITH {SCORED_DOCUMENTS}
            SELECT doc_id,
                   len(list_filter({_tokens("txt")}, lambda t: t = '{KEYWORD}')) AS n_hits,
                   context_text
            FROM scored""",
        "q_context_score": f"""
            WITH {SCORED_DOCUMENTS}
            SELECT doc_id, round(context_sim, 6) AS context_sim,
                   round(context_score, 6) AS context_score
            FROM scored""",
        "q_score": f"""
            WITH {SCORED_DOCUMENTS}
            SELECT doc_id, exact, round(score, 6) AS score FROM scored""",
        "q_href": f"WITH {LINKS} SELECT page_id, link_pos, href_url FROM links",
        "q_scored_links": f"WITH {SCORED_LINKS} SELECT {_ANALYSIS_COLUMNS} FROM scored",
        "q_unscored": f"""
            WITH {ITEMS}
            SELECT seq::VARCHAR AS seq, raw_keyword AS keyword, href, text FROM items
            WHERE NOT starts_with(url, 'https') AND NOT contains(href, 'http')""",
        "q_catalog": f"WITH {CATALOG} SELECT * FROM catalog",
        "q_compacted_catalog": f"""
            WITH {CATALOG}
            SELECT id, keyword, source_url, href_url,
                   CASE WHEN keyword = '{KEYWORDS[1].lower()}' THEN 0.5::DOUBLE ELSE relevance_score END
                     AS relevance_score, raw_text
            FROM catalog""",
        "q_clear_queue": f"""
            WITH {ITEMS}
            SELECT CASE WHEN link_pos % 3 = 2 THEN 'left' ELSE 'archived' END AS place,
                   raw_keyword AS keyword, count(*) AS n_items
            FROM items GROUP BY ALL
            UNION ALL SELECT 'processed', raw_keyword, count(*) FROM items GROUP BY ALL""",
        "q_containers": f"""
            WITH {LINKS},
            counts AS (SELECT page_id, count(*) AS n FROM links GROUP BY page_id)
            SELECT page_id, container, link_pos,
                   (seq + CASE WHEN container = 'div' THEN n ELSE 0 END)::VARCHAR AS seq, href, processed_text
            FROM links JOIN counts USING (page_id), (VALUES ('body'), ('div')) AS c(container)""",
        "q_link_attributes": "WITH "
        + LINKS.replace(
            "[text, title, new_domain]",
            f"""[text, 'to ' || {_HOST_AS_WRITTEN} || ' & on', 'Label of ' || {_HOST_AS_WRITTEN}, title,
             'About ' || {_HOST_AS_WRITTEN}, new_domain]""",
        )
        + f""" SELECT page_id, link_pos, 'to ' || {_HOST_AS_WRITTEN} || ' & on' AS title,
                   'Label of ' || {_HOST_AS_WRITTEN} AS aria_label,
                   'About ' || {_HOST_AS_WRITTEN} AS description, processed_text
            FROM links""",
        "q_vector_scores": f"""
            WITH {ITEMS}, {VECTOR_SCORES},
            scored AS (SELECT items.*, score FROM items JOIN scores USING (txt, keyword))
            SELECT {_ANALYSIS_COLUMNS} FROM scored""",
        "q_vector_store": f"""
            WITH {ITEMS}, {VECTOR_SCORES},
            needed AS (
              SELECT DISTINCT run, x AS text
              FROM (VALUES (1, '{KEYWORDS[0].lower()}'), (2, '{KEYWORDS[0].lower()}'), (2, '{KEYWORDS[1].lower()}'),
                           (3, '{KEYWORDS[0].lower()}'), (3, '{KEYWORDS[1].lower()}')) AS r(run, keyword)
              JOIN (SELECT keyword, txt AS x FROM scores UNION SELECT keyword, keyword FROM scores
                    UNION SELECT keyword, context_text FROM scores
                    WHERE exact > 0 AND context_text IS NOT NULL) USING (keyword)),
            firsts AS (SELECT text, min(run) AS run FROM needed GROUP BY text)
            SELECT n.run, count(*) AS n_needed, (SELECT count(*) FROM firsts f WHERE f.run = n.run) AS n_encoded,
                   (SELECT count(*) FROM firsts f WHERE f.run <= n.run) AS n_stored
            FROM needed n GROUP BY n.run""",
        "q_upsert": f"""
            WITH {LINKS},
            last_links AS (
              SELECT url AS source_url, href_url, max(link_pos) AS pos,
                     arg_max(text, link_pos) AS text
              FROM links GROUP BY ALL),
            hits AS (
              SELECT url AS source_url, href_url, max(link_pos) AS hit_pos,
                     arg_max(text, link_pos) AS hit_text
              FROM links WHERE contains(lower(text), '{KEYWORD}') GROUP BY ALL)
            SELECT '{KEYWORD}' AS keyword, source_url, href_url,
                   coalesce(hit_pos / 100.0::DOUBLE, pos::DOUBLE) AS relevance_score,
                   coalesce(hit_text, text) AS text
            FROM last_links LEFT JOIN hits USING (source_url, href_url)""",
        "q_by_keyword": f"WITH {CATALOG} SELECT * FROM catalog WHERE keyword = '{KEYWORD}'",
        "q_by_source": f"WITH {CATALOG} SELECT * FROM catalog WHERE source_url = {_FIRST_URL}",
        "q_by_both": f"""
            WITH {CATALOG} SELECT * FROM catalog
            WHERE keyword = '{KEYWORD}' AND source_url = {_FIRST_URL}""",
        "q_result_count": f"""
            WITH {CATALOG} SELECT count(*) AS count FROM catalog WHERE keyword = '{KEYWORD}'""",
        "q_href_lookup": f"""
            WITH {CATALOG}
            SELECT href_url, source_url, keyword, relevance_score FROM catalog
            WHERE href_url = (SELECT max(href_url) FROM links)
            ORDER BY keyword, source_url LIMIT 1""",
        "q_best_links": f"""
            WITH {SCORED_LINKS}, {_BEST}
            SELECT source_url, keyword, href_url, round(score, 6) AS score,
                   first_seq::VARCHAR AS first_seq
            FROM best""",
        "q_ranked_links": f"WITH {SCORED_LINKS}, {_BEST} SELECT {_RANKED_COLUMNS} FROM ranked",
        "q_top_links": f"""
            WITH {SCORED_LINKS}, {_BEST} SELECT {_RANKED_COLUMNS} FROM ranked WHERE rank <= 3""",
        "q_scrape_result": f"""
            WITH {SCORED_LINKS}, {_BEST},
            counts AS (
              SELECT source_url, keyword, count(*) AS count FROM ranked GROUP BY ALL)
            SELECT source_url, keyword, (rank - 1) // 4 AS chunk, count,
                   string_agg(href_url, ' ' ORDER BY rank) AS urls,
                   round(max(score), 6) AS best_score
            FROM ranked JOIN counts USING (source_url, keyword)
            GROUP BY ALL""",
        "q_score_pct": f"""
            WITH {SCORED_LINKS}, {_BEST}
            , percent_parts AS (
              SELECT source_url, keyword, href_url, CAST(floor(score * 100) AS BIGINT) AS whole,
                score * 100 - floor(score * 100) AS f
              FROM best
            ), tenths AS (
              -- Exact limits are below the double of 0.05, 0.45, ..., above that of 0.15, 0.35, ...
              SELECT *, whole * 10 + CASE
                WHEN f > 0.95::DOUBLE THEN 10 WHEN f > 0.85::DOUBLE THEN 9
                WHEN f >= 0.75::DOUBLE THEN 8 WHEN f >= 0.65::DOUBLE THEN 7
                WHEN f >= 0.55::DOUBLE THEN 6 WHEN f >= 0.45::DOUBLE THEN 5
                WHEN f > 0.35::DOUBLE THEN 4 WHEN f >= 0.25::DOUBLE THEN 3
                WHEN f > 0.15::DOUBLE THEN 2 WHEN f >= 0.05::DOUBLE THEN 1 ELSE 0 END AS n
              FROM percent_parts
            )
            SELECT source_url, keyword, href_url, (n // 10) || '.' || (n % 10) || '%' AS shown
            FROM tenths""",
        "q_run_errors": f"""
            WITH {ROBOTS}
            SELECT 'robots_txt_error' AS error, url FROM decided
            WHERE NOT allowed AND starts_with(url, 'https')
            UNION ALL SELECT 'fetch_failed', 'http://absent.example/'""",
        "q_end_to_end": f"""
            WITH {SCORED_LINKS.replace("scored AS", "all_scored AS")}, {ROBOTS},
            scored AS (
              SELECT all_scored.* FROM all_scored JOIN decided USING (page_id)
              WHERE allowed AND (raw_keyword = '{KEYWORDS[0]}' OR starts_with(decided.url, 'https'))
            ), {_BEST}
            SELECT {_RANKED_COLUMNS} FROM ranked""",
    }
