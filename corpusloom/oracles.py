"""SQL for DuckDB that gives the same rows as the engine's queries."""

from __future__ import annotations

# URL pieces of pages, without regular expression look-around
PARTS = r"""
u AS (
    SELECT page_id, url, html, lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) AS scheme, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)) AS host,
           regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(url, '^[^?#]*\?([^#]*)', 1) AS query
    FROM pages
)"""
# of (scheme, host, path, query): the normal form. The tables' parameters need no coding.
NORM = r"""
scheme || '://' || host ||
CASE WHEN p0 = '/' THEN '/' ELSE regexp_replace(p0, '/+$', '') END ||
CASE WHEN len(qs) > 0 THEN '?' || array_to_string(qs, '&') ELSE '' END"""
NORMAL = (
    PARTS
    + r""", q AS (
    SELECT *, CASE WHEN path = '' THEN '/' ELSE regexp_replace(path, '/index\.(html|htm|php)$', '/', 'i') END AS p0,
           list_sort(list_filter(string_split(query, '&'), lambda x: x <> '' AND lower(split_part(x, '=', 1)) NOT IN ('utm_source', 'utm_medium', 'utm_campaign', 'utm_term', 'utm_content', 'fbclid', 'gclid', 'ref', 'source'))) AS qs
    FROM u
), n AS (SELECT *, """
    + NORM
    + " AS norm FROM q)"
)
VALID = r"""(scheme IN ('http', 'https') AND length(url) <= 2000
 AND regexp_extract(lower(path), '(\.[^./]*)$', 1) NOT IN ('.jpg', '.jpeg', '.png', '.gif', '.svg', '.webp', '.ico', '.bmp', '.tiff', '.zip', '.rar', '.exe', '.mp4', '.mp3', '.avi', '.mov', '.css', '.js', '.woff', '.woff2')
 AND NOT (regexp_matches(lower(path), '/images/|/media/|/assets/') AND regexp_matches(lower(path), '\.(jpg|jpeg|png|gif|webp)')))"""


def _score(url: str, base: int) -> str:
    return f"CAST({base} - CASE WHEN regexp_matches(lower({url}), 'policy|om-oss|kontakt|regler|guide') THEN 3 ELSE 0 END + CASE WHEN regexp_matches(lower({url}), 'nyheter|arkiv|blogg|kalender|202') THEN 5 ELSE 0 END AS INTEGER)"


LINKS = r"""
l0 AS (SELECT page_id, url, scheme, host, regexp_extract_all(html, '(?i)<a\s[^>]*href="([^"]*)"', 1) AS hs FROM u),
l AS (SELECT page_id, url, scheme, host, i - 1 AS position, trim(replace(hs[i], '&amp;', '&')) AS href FROM (SELECT *, unnest(range(1, len(hs) + 1)) AS i FROM l0)),
k AS (SELECT *, scheme || '://' || regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1) || href AS target FROM l WHERE NOT regexp_matches(href, '^(#|javascript:|mailto:)'))"""
# links as URLs of their own: all are rooted paths without query
LINK_NORM = r"""
t AS (
    SELECT *, scheme || '://' || host || CASE WHEN href = '/' THEN '/' ELSE regexp_replace(regexp_replace(regexp_replace(href, '[?#].*$', ''), '/index\.(html|htm|php)$', '/', 'i'), '/+$', '') END AS norm
    FROM k
)"""
ENTRIES = f"{NORMAL}, v AS (SELECT * FROM n WHERE {VALID}), e AS (SELECT norm AS url, page_id AS seq, {_score('norm', 15)} AS score FROM v QUALIFY row_number() OVER (PARTITION BY norm ORDER BY page_id) = 1)"
EMAIL = r"regexp_replace({x}, '\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{{2,}}\b', '[E-POST]', 'g')"
IP = r"regexp_replace({x}, '\b(?:\d{{1,3}}\.){{3}}\d{{1,3}}\b', '[IP-ADRESS]', 'g')"
# RE2 has no look-around: what stands beside a number is matched and put back, twice, as neighbours share it
PNR_ONCE = r"regexp_replace({x}, '(^|[^\p{{Nd}}])(?:(?:19|20)?\p{{Nd}}{{2}}(?:0[1-9]|1[0-2])(?:0[1-9]|[12]\p{{Nd}}|3[01]|[6-9]\p{{Nd}})[-+]?\p{{Nd}}{{4}})([^\p{{Nd}}]|$)', '\1[PERSONNUMMER]\2', 'g')"
PHONE_ONCE = (
    r"regexp_replace({x}, '(^|[^\p{{Nd}}])(?:(?:\+|00)46[\s\p{{Z}}-]*\(?0\)?[\s\p{{Z}}-]*[1-9]|0[\s\p{{Z}}-]*\(?[1-9]\)?)[\s\p{{Z}}-]*\p{{Nd}}(?:[\s\p{{Z}}-]*\p{{Nd}}){{4,8}}"
    r"([^\p{{L}}\p{{M}}\p{{Nd}}_]|$)', '\1[TELEFON]\2', 'g')"
)


def _masked(x: str, *patterns: str) -> str:
    for p in patterns:
        x = p.format(x=x)
    return x


PNR, PHONE = (PNR_ONCE, PNR_ONCE), (PHONE_ONCE, PHONE_ONCE)
ALL_KINDS = (EMAIL, *PNR, *PHONE, IP)


def _clean(x: str) -> str:
    return _masked(x, *ALL_KINDS)


CLEAN = _clean("text")
CHUNKS = r"""
w AS (SELECT doc_id, body, list_filter(regexp_split_to_array(body, '\s+'), lambda x: x <> '') AS ws FROM (SELECT doc_id, regexp_replace(regexp_replace({text}, '^\s+', ''), '\s+$', '') AS body FROM documents)),
s AS (SELECT doc_id, body, ws, len(ws) AS n, CASE WHEN len(ws) <= 400 THEN 1 ELSE CAST(ceil((len(ws) - 50) / 350.0) AS BIGINT) END AS total FROM w WHERE body <> ''),
c AS (SELECT *, unnest(range(0, total)) AS k FROM s),
ch AS (
    SELECT doc_id, k + 1 AS chunk_index, total AS total_chunks, CASE WHEN n <= 400 THEN body ELSE array_to_string(ws[350 * k + 1 : 350 * k + 400], ' ') END AS content,
           CASE WHEN k = 0 THEN 'Huvudinnehåll' ELSE 'Huvudinnehåll (del ' || (k + 1) || ')' END AS heading
    FROM c
)"""
HASH = r"sha256(lower(regexp_replace({x}, '\s+', '', 'g')))"
DOCS = f"""docs AS (
    SELECT 'https://site.example/doc/' || doc_id AS url, doc_id, {HASH.format(x="text")} AS content_hash, source AS title, TIMESTAMP '2026-01-01' + to_seconds(doc_id) AS crawled_at, length(text) AS content_length, lang
    FROM documents
), old AS (
    SELECT CASE WHEN lang = 'en' THEN url ELSE 'https://site.example/arkiv/' || doc_id END AS url, CASE WHEN content_length % 10 = 0 THEN repeat('0', 64) ELSE content_hash END AS content_hash, title,
           TIMESTAMP '2026-01-01' + to_seconds(CASE WHEN title = 'src1' THEN doc_id + 10 ELSE -1 END) AS crawled_at, content_length
    FROM docs
), upserted AS (
    SELECT url, content_hash, title, crawled_at, content_length FROM (SELECT *, 0 AS fresh FROM old UNION ALL SELECT url, content_hash, title, crawled_at, content_length, 1 FROM docs)
    QUALIFY row_number() OVER (PARTITION BY url ORDER BY crawled_at DESC, fresh DESC) = 1
)"""
STATUS = "CASE event_id % 7 WHEN 0 THEN 'new' WHEN 1 THEN 'changed' WHEN 2 THEN 'unchanged' WHEN 3 THEN 'failed' WHEN 4 THEN 'expired' WHEN 5 THEN 'document' ELSE 'skipped' END"
STATS = f"""st AS (
    SELECT 'site' || (user_id % 7) AS site, count(*) FILTER (WHERE s IN ('new', 'changed', 'unchanged')) AS visited, count(*) FILTER (WHERE s = 'unchanged') AS unchanged,
           count(*) FILTER (WHERE s IN ('failed', 'expired')) AS failed, count(*) FILTER (WHERE s = 'document') AS documents, count(*) FILTER (WHERE value > 50) AS playwright_fallbacks
    FROM (SELECT *, {STATUS} AS s FROM events) GROUP BY 1
)"""
# the tables' pages have one heading, in an article of paragraphs; of what HTML leaves open, a paragraph ends where the next begins
PAGES = rf"""ar AS (
    SELECT page_id, url, html, regexp_extract(html, '(?s)<article>(.*?)</article>', 1) AS a FROM pages
), pa AS (
    SELECT *, regexp_extract(a, '(?s)<h1>(.*?)</h1>', 1) AS h, list_filter(list_transform(string_split(regexp_extract(a, '(?s)</h1>(.*)$', 1), '<p>'),
           lambda x: trim({{text}}, chr(32) || chr(10) || chr(9))), lambda x: x <> '') AS ps
    FROM ar
), pt AS (
    SELECT page_id, url, html, ps, {_clean("{title}")} AS title, trim({{heading}}) AS raw_heading, array_to_string(list_filter(ps, lambda x: length(x) >= 6), chr(10)) AS raw FROM pa
), pr AS (
    SELECT page_id, url, html, ps, title, {_clean("raw_heading")} AS heading, {_clean("raw")} AS text, regexp_extract(html, '(?i)<html[^>]*\slang="([^"]*)"', 1) AS language FROM pt
), rec AS (
    SELECT *, CASE WHEN text = '' THEN '' ELSE '## ' || heading || chr(10) || text END AS plain_text, len(regexp_split_to_array(text, '\s+')) AS n FROM pr
)"""


def _plain(x: str) -> str:
    """Without tags, entities as what they stand for."""
    for entity, plain in (
        ("&lt;", "'<'"), ("&gt;", "'>'"), ("&quot;", "chr(34)"), ("&#39;", "chr(39)"), ("&nbsp;", "chr(160)"),
        ("&amp;", "'&'")
    ):
        x = f"replace({x}, '{entity}', {plain})"
    return x


TITLE = "replace(replace(replace(replace(replace(replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&')"


PAGES = PAGES.replace(
    "{text}", _plain("regexp_replace(x, '<[^>]*>', '', 'g')")
).replace("{heading}", _plain("h")).replace("{title}", f"trim({TITLE})")
#: Of pr and rec, with the form of valid URLs: what a run takes.
RUN = f"{NORMAL}, {PAGES}, taken AS (SELECT rec.*, n.norm, n.scheme, n.host, n.path, n.query, regexp_extract(n.norm, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS np FROM n JOIN rec USING (page_id) WHERE {VALID.replace('length(url)', 'length(n.url)')})"
SLUG = r"lower(regexp_replace(regexp_replace(regexp_replace(translate({x}, 'åäöÅÄÖ', 'aaoAAO'), '[^\p{{L}}\p{{N}}_\s-]', '', 'g'), '[-\s]+', '-', 'g'), '^-+|-+$', '', 'g'))"
FILE = f"left({SLUG.format(x='np')}, 50) || '_' || left({HASH.format(x='plain_text')}, 6)"
PAYLOAD = "'# ' || title || chr(10) || 'Källa: ' || norm || chr(10) || chr(10) || plain_text"
SITE = f"""dealt AS (
    SELECT *, CASE WHEN regexp_matches(url, '://m\\.') THEN 'mobil' WHEN contains(url, '/fr/') THEN 'fr' ELSE 'rest' END AS site FROM taken
), ruled AS (
    SELECT * FROM dealt WHERE CASE site WHEN 'mobil' THEN NOT contains(lower(url), '/de/') WHEN 'rest' THEN NOT starts_with(path, '/en/1') ELSE true END
)"""
# breadth first over the tree of pages, where page k leads to 2k + 1 and 2k + 2; a page may be taken if its address as found passes
CRAWL = f"""WITH RECURSIVE {NORMAL.removeprefix(chr(10))}, ok AS (
    SELECT page_id, norm, {VALID} AND NOT regexp_matches(lower(url), '/de/1|spam') AND NOT starts_with(path, '/es/2') AS fine FROM n
), first_page AS (SELECT norm, min_by(page_id, url) AS page_id FROM n GROUP BY norm),
v(norm, depth) AS (
    SELECT norm, 0 FROM n WHERE page_id = 0
    UNION
    SELECT c.norm, v.depth + 1 FROM v JOIN first_page f ON f.norm = v.norm JOIN ok c ON c.page_id IN (2 * f.page_id + 1, 2 * f.page_id + 2) WHERE c.fine
), least AS (SELECT norm, min(depth) AS depth FROM v GROUP BY norm)
SELECT norm AS url, CAST(depth AS INTEGER) AS depth, CAST(CASE WHEN depth = 0 THEN {{zero}} ELSE {{rest}} + depth END AS INTEGER) AS score, CAST(depth AS INTEGER) AS round FROM least"""
CRAWL = CRAWL.replace("{zero}", _score("norm", 1)).replace("{rest}", _score("norm", 15))


def _values(names: str, *rows: str) -> str:
    return f"SELECT * FROM (VALUES {', '.join(rows)}) AS v({names})"


ORACLES = {
    "url_normalize": f"WITH {NORMAL} SELECT page_id, norm AS norm_url FROM n",
    "url_distinct": f"WITH {NORMAL} SELECT count(DISTINCT norm) AS n_urls FROM n",
    "url_valid": f"WITH {PARTS} SELECT page_id, {VALID} AS valid, {VALID} AND replace(host, 'www.', '') = 'ththen.example.com' AS valid_strict, {VALID} AS valid_own FROM u",
    "url_keywords": f"WITH {PARTS} SELECT page_id, url FROM u WHERE {VALID} AND NOT regexp_matches(lower(url), 'spam|pills') AND regexp_matches(lower(url), '/en/|/de/|1')",
    "frontier_score": f"WITH {NORMAL} SELECT page_id, {_score('norm', 15)} AS score, {_score('norm', 7)} AS sitemap_score FROM n",
    "frontier_topk": f"WITH {ENTRIES} SELECT row_number() OVER (ORDER BY score, seq, url) AS rank, url, score, seq FROM e QUALIFY rank <= 20",
    "frontier_dedup": f"WITH {ENTRIES} SELECT url, seq, score FROM e",
    "links_extracted": f"WITH {PARTS}, {LINKS} SELECT page_id, position, href FROM k",
    "links_resolved": f"WITH {PARTS}, {LINKS} SELECT page_id, position, target FROM k",
    "links_parsed": f"WITH {PARTS}, {LINKS} SELECT page_id, position, href, target FROM k",
    "links_new": f"WITH {NORMAL}, {LINKS}, {LINK_NORM} SELECT DISTINCT norm AS url FROM t WHERE norm NOT IN (SELECT norm FROM n)",
    "frontier_expand": f"WITH {ENTRIES}, {LINKS}, {LINK_NORM} SELECT url, CAST(min(depth) AS INTEGER) AS depth FROM (SELECT url, 0 AS depth FROM e UNION ALL SELECT norm, 1 FROM (SELECT target AS url, scheme, href AS path, norm FROM t) WHERE {VALID}) GROUP BY url",
    "expand_gate": f"""WITH {NORMAL}, {LINKS}, {LINK_NORM}, g AS (SELECT norm, page_id * 100000 + position AS seq, page_id % 3 + 1 AS depth FROM (SELECT target AS url, scheme, href AS path, norm, page_id, position FROM t) WHERE {VALID} AND page_id % 3 < 2)
        SELECT norm AS url, CAST(depth AS INTEGER) AS depth, CAST({_score('norm', 15)} + depth AS INTEGER) AS score FROM g QUALIFY row_number() OVER (PARTITION BY norm ORDER BY seq) = 1""",
    "crawl_visits": CRAWL,
    "page_sections": f"WITH {PAGES} SELECT page_id, 0::BIGINT AS position, heading, text FROM rec WHERE text <> ''",
    "page_record": f"""WITH {PAGES} SELECT page_id, title, url, '' AS author, '' AS published_date, '' AS modified_date, language, '' AS og_type, '' AS description, 0::BIGINT AS n_keywords,
        CAST(CASE WHEN text = '' THEN 0 WHEN n <= 400 THEN 1 ELSE ceil((n - 50) / 350.0) END AS BIGINT) AS n_chunks, length(plain_text) AS n_chars, sha256(plain_text) AS text_sha256 FROM rec""",
    "page_main_text": f"""WITH {PAGES}, m AS (SELECT *, list_sum(list_transform(ps, lambda x: length(x))) >= 80 AS found FROM rec)
        SELECT page_id, CASE WHEN found THEN {_clean("'# ' || heading || chr(10) || chr(10) || array_to_string(ps, chr(10) || chr(10))")} ELSE plain_text END AS plain_text, CAST(CASE WHEN text = '' THEN 0 ELSE 1 END AS BIGINT) AS n_sections FROM m""",
    "page_metadata": _values(
        "id, title, keywords, description, author, published_date, modified_date, language, og_type, failed",
        "(1::BIGINT, 'T1', 'a|b||c', 'd', 'A', '2020-01-01', '2020-02-02', 'sv', 'article', false)", "(2, 'T2', '', '', 'B', '2019', '2021-03-04', '', '', false)", "(3, 'T3', '', '', '', '2018-05-06', '2018-07-08', '', '', false)",
        "(4, 'T4', '', '', '', '', '3 maj 2021', '', '', false)", "(5, 'T5', '', '', '', '2019-02-03', 'i dag', '', '', false)", "(6, 'Okänd', '', '', '', '', '', '', '', false)", "(7, '', '', '', '', '', '', '', '', true)",
        "(8, 'skriv till [E-POST]', '[E-POST]', '', '', '', '', '', '', false)",
    ),
    "page_shapes": _values(
        "id, position, heading, text", "(1::BIGINT, 0::BIGINT, 'Huvudinnehåll', 'inledning har')", "(1, 1, 'Lista', '• ett [lank](https://a.se/x)' || chr(10) || '• tva inre' || chr(10) || '• inre' || chr(10) || '• inre')",
        "(2, 0, 'Tabell', '| A | B |' || chr(10) || '|---|---|' || chr(10) || '| 1 | 2 |')", "(3, 0, 'R', 'text med fet och [mer](https://a.se/d/y?z=1)')",
    ),
    "run_pages": f"WITH {RUN} SELECT {FILE} || '.md' AS file_name, {PAYLOAD} AS payload FROM taken WHERE length(plain_text) > 50",
    "run_pages_json": f"""WITH {RUN}, w AS (
            SELECT *, regexp_split_to_array(text, '\\s+') AS ws, CASE WHEN text = '' THEN 0 WHEN n <= 400 THEN 1 ELSE CAST(ceil((n - 50) / 350.0) AS BIGINT) END AS total FROM taken WHERE length(plain_text) > 50
        ), c AS (
            SELECT *, list_transform(range(0, total), lambda k: '    {{' || chr(10) || '      "heading": ' || to_json(heading || CASE WHEN k = 0 THEN '' ELSE ' (del ' || (k + 1) || ')' END) || ',' || chr(10)
                || '      "content": ' || to_json(CASE WHEN n <= 400 THEN text ELSE array_to_string(ws[350 * k + 1 : 350 * k + 400], ' ') END) || ',' || chr(10)
                || '      "chunk_index": ' || (k + 1) || ',' || chr(10) || '      "total_chunks": ' || total || chr(10) || '    }}') AS chunks FROM w
        )
        SELECT {FILE} || '.json' AS file_name, '{{' || chr(10) || '  "title": ' || to_json(title) || ',' || chr(10) || '  "url": ' || to_json(norm) || ',' || chr(10)
            || '  "crawled_at": "2026-01-01T00:00:00",' || chr(10) || '  "author": "",' || chr(10) || '  "published_date": "",' || chr(10) || '  "modified_date": "",' || chr(10)
            || '  "language": ' || to_json(language) || ',' || chr(10) || '  "og_type": "",' || chr(10) || '  "description": "",' || chr(10) || '  "keywords": [],' || chr(10)
            || '  "chunks": [' || chr(10) || array_to_string(chunks, ',' || chr(10)) || chr(10) || '  ]' || chr(10) || '}}' AS payload FROM c""",
    "sites_stats": f"WITH {RUN}, {SITE} SELECT site, count(*) AS visited, 0::BIGINT AS unchanged, 0::BIGINT AS failed, 0::BIGINT AS documents, count(*) AS saved FROM ruled GROUP BY site",
    "sites_saved": f"WITH {RUN}, {SITE} SELECT {FILE} || CASE site WHEN 'mobil' THEN '.txt' ELSE '.md' END AS file_name, sha256({PAYLOAD.replace('|| plain_text', '|| plain_text')}) AS payload_sha256 FROM ruled WHERE site <> 'fr' AND length(plain_text) > 50",
    "responses_routed": _values(
        "id, route, rendered, n_html", "(1::BIGINT, 'page', false, 1200::BIGINT)", "(2, 'page', true, 18)",
        "(3, 'page', false, 4)", "(4, 'document', false, NULL)", "(5, 'document', false, NULL)",
        "(6, 'document', false, NULL)", "(7, 'drop', false, NULL)", "(8, 'empty', false, NULL)",
        "(9, 'document', false, NULL)"
    ),
    "responses_documents": "SELECT url, 'a_' || left(md5(url), 6) || '.pdf' AS file_name, 'P2' AS body FROM (VALUES ('https://a.se/f/a.pdf')) v(url)",
    "head_probes": _values("id, content_type", "(1::BIGINT, 'text/html')", "(2, NULL)", "(3, NULL)", "(4, '')", "(5, 'image/png')"),
    "cookie_headers": _values("id, header", "(1::BIGINT, 'a=1; b=x=y')", "(2, '')"),
    "newest_events": "SELECT ts, event_id, event_type FROM events ORDER BY ts DESC, event_id, event_type LIMIT 100",
    "table_titles": _values("id, title", "(1::BIGINT, 'ab')", "(2, 'Ingen titel')", "(3, 'Ingen titel')", "(4, 'Titel')"),
    "keyword_lists": _values("id, words", "(1::BIGINT, 'spam|piller|å b')", "(2, '')", "(3, '')"),
    "json_files": _values(
        "payload",
        """('{' || chr(10) || '  "title": "T \\"x\\"",' || chr(10) || '  "keywords": [' || chr(10) || '    "a",' || chr(10) || '    "b\\\\"' || chr(10) || '  ],' || chr(10) || '  "chunks": [' || chr(10) || '    {' || chr(10)
           || '      "heading": "H",' || chr(10) || '      "content": "rad 1\\nrad 2",' || chr(10) || '      "chunk_index": 1,' || chr(10) || '      "total_chunks": 1' || chr(10) || '    }' || chr(10) || '  ]' || chr(10) || '}')""",
        """('{' || chr(10) || '  "title": "tom",' || chr(10) || '  "keywords": [],' || chr(10) || '  "chunks": []' || chr(10) || '}')""",
    ),
    "sitemap_accepted": f"""WITH {NORMAL}, s AS (SELECT norm, CASE WHEN contains(url, '/en/') THEN 'b' ELSE 'a' END AS sitemap FROM n WHERE {VALID} AND NOT contains(lower(url), '/de/')),
        o AS (SELECT norm, min(sitemap) AS sitemap FROM s GROUP BY norm) SELECT sitemap, count(*) AS n FROM o WHERE norm NOT IN (SELECT norm FROM n WHERE contains(url, '/fr/')) GROUP BY sitemap""",
    "page_title": f"SELECT page_id, CASE WHEN regexp_matches(html, '(?i)<title[\\s>]') THEN trim({TITLE}) ELSE 'Okänd' END AS title FROM pages",
    "page_lang": "SELECT page_id, regexp_extract(html, '(?i)<html[^>]*\\slang=\"([^\"]*)\"', 1) AS language FROM pages",
    "page_title_parsed": f"SELECT page_id, trim({TITLE}) AS title, regexp_extract(html, '(?i)<html[^>]*\\slang=\"([^\"]*)\"', 1) AS language FROM pages",
    "js_render_needed": "SELECT page_id, length(html) < 1000 OR contains(lower(html), 'enable javascript') AS needed FROM pages",
    "session_expired": "SELECT page_id, regexp_matches(lower(html), 'name=\"password\"|action=\"login\"|id=\"loginform\"|type=\"password\"|cas/login|adfs/ls|saml|inloggning krävs|du måste logga in') AS expired, true AS with_form FROM pages",
    "content_hash": f"SELECT doc_id, {HASH.format(x='text')} AS content_hash FROM documents",
    "pii_email": f"SELECT doc_id, sha256({EMAIL.format(x='text')}) AS masked FROM documents",
    "pii_ip": f"SELECT doc_id, sha256({IP.format(x='text')}) AS masked FROM documents",
    "pii_pnr": f"SELECT doc_id, sha256({_masked('text', *PNR)}) AS masked FROM documents",
    "pii_phone": f"SELECT doc_id, sha256({_masked('text', *PHONE)}) AS masked FROM documents",
    "pii_masked": f"SELECT doc_id, {CLEAN} AS masked FROM documents",
    "chunks": f"WITH {CHUNKS.format(text='text')} SELECT doc_id, chunk_index, total_chunks, sha256(content) AS content_sha256 FROM ch",
    "chunk_stats": f"WITH {CHUNKS.format(text='text')} SELECT doc_id, count(*) AS n_chunks, CAST(sum(length(content)) AS BIGINT) AS n_chars, max(len(list_filter(regexp_split_to_array(content, '\\s+'), lambda x: x <> ''))) AS most_words FROM ch GROUP BY doc_id",
    "chunk_headings": f"WITH {CHUNKS.format(text='text')} SELECT doc_id, chunk_index, heading FROM ch",
    "masked_chunks": f"WITH {CHUNKS.format(text=CLEAN)}, h AS (SELECT doc_id, {HASH.format(x=CLEAN)} AS content_hash FROM documents) SELECT doc_id, content_hash, chunk_index, heading, content FROM ch JOIN h USING (doc_id)",
    "slug_filename": f"""WITH {NORMAL}, g AS (SELECT page_id, html, {{slug}} AS slug, {{norm_slug}} AS norm_slug FROM (SELECT *, regexp_extract(norm, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS np FROM n))
        SELECT page_id, slug, left(norm_slug, 50) || '_' || left({HASH.format(x='html')}, 6) || '.md' AS file_name FROM g""".format(
        **{k: f"lower(regexp_replace(regexp_replace(regexp_replace(translate({p}, 'åäöÅÄÖ', 'aaoAAO'), '[^\\p{{L}}\\p{{N}}_\\s-]', '', 'g'), '[-\\s]+', '-', 'g'), '^-+|-+$', '', 'g'))" for k, p in (("slug", "path"), ("norm_slug", "np"))}
    ),
    "cache_upsert": f"WITH {DOCS} SELECT * FROM upserted",
    "cache_scan": f"WITH {DOCS} SELECT url, title, crawled_at, content_hash, row_number() OVER (ORDER BY crawled_at DESC, url) AS place FROM upserted",
    "incremental_status": f"WITH {DOCS} SELECT d.url, d.content_hash, CASE WHEN o.url IS NULL THEN 'new' WHEN o.content_hash = d.content_hash THEN 'unchanged' ELSE 'changed' END AS status FROM docs d LEFT JOIN old o USING (url)",
    "index_csv": f"WITH {DOCS} SELECT url AS page, title AS titel, strftime(crawled_at, '%Y-%m-%d %H:%M:%S') AS fetched, 'doc' || doc_id || '_' || left(content_hash, 6) || '.md' AS filnamn, row_number() OVER (ORDER BY crawled_at DESC, url) AS place FROM docs",
    "crawl_stats": f"WITH {STATS} SELECT *, visited - unchanged AS saved FROM st",
    "crawl_rate": "SELECT user_id % 7 AS site, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1000000 AS seconds, round(count(*) / ((epoch_us(max(ts)) - epoch_us(min(ts))) / 1000000), 6) AS rate FROM events GROUP BY 1",
    "summary_lines": f"WITH {STATS} SELECT site, ' - ' || site || ': ' || visited || ' besökta, ' || failed || ' fel.' AS line FROM st",
    "eta": _values(
        "id, eta", "(1::BIGINT, 'Beräknar...')", "(2, 'Klar snart')", "(3, '10s')", "(4, '3m 20s')", "(5, '1h 40m')",
        "(6, '10s')", "(7, 'Klar snart')"
    ),
    "rate_limit_schedule": """WITH RECURSIVE r AS (SELECT event_id AS id, user_id, epoch_us(ts) AS a, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
        s AS (SELECT id, user_id, a, k, a AS start_us FROM r WHERE k = 1 UNION ALL SELECT r.id, r.user_id, r.a, r.k, greatest(r.a, s.start_us + 600000000) FROM s JOIN r ON r.user_id = s.user_id AND r.k = s.k + 1)
        SELECT id, start_us, start_us - a AS wait_us FROM s""",
    "eta_events": """WITH e AS (SELECT event_id, event_id % 50 AS visited, value * 40 AS seconds, CASE WHEN (event_id % 3) * 30 > 0 THEN least(user_id % 40, (event_id % 3) * 30 - event_id % 50) ELSE user_id % 40 END AS left_ FROM events),
        s AS (SELECT *, CASE WHEN visited > 0 THEN seconds / visited * left_ END AS s FROM e)
        SELECT event_id, CASE WHEN visited <= 2 THEN 'Beräknar...' WHEN left_ <= 0 THEN 'Klar snart' WHEN s > 3600 THEN CAST(floor(s / 3600) AS BIGINT) || 'h ' || CAST(floor((s - floor(s / 3600) * 3600) / 60) AS BIGINT) || 'm'
            WHEN s > 60 THEN CAST(floor(s / 60) AS BIGINT) || 'm ' || CAST(floor(s - floor(s / 60) * 60) AS BIGINT) || 's' ELSE CAST(floor(s) AS BIGINT) || 's' END AS eta FROM s""",
    "delay_events": "SELECT event_id, CASE WHEN user_id % 3 = 2 THEN 1.0::DOUBLE ELSE greatest(value / 1000, 0.1::DOUBLE) END AS delay FROM events",
    "route_events": """SELECT event_id, CASE event_id % 11 WHEN 0 THEN 'page' WHEN 5 THEN 'page' WHEN 10 THEN 'page' WHEN 2 THEN d WHEN 3 THEN d WHEN 7 THEN 'empty' WHEN 8 THEN 'empty' ELSE 'drop' END AS route
        FROM (SELECT event_id, CASE WHEN user_id % 2 = 0 THEN 'document' ELSE 'skip_document' END AS d FROM events)""",
    "delay_resolution": _values("id, delay", "(1::BIGINT, 0.5::DOUBLE)", "(2, 0.1)", "(3, 1.0)", "(4, 10.0)", "(5, 0.5)"),
    "backoff_schedule": _values("attempts, seconds", "(0::BIGINT, '')", "(1, '1')", "(2, '1,2')", "(3, '1,2,4')", "(4, '1,2,4,8')"),
    "content_route": _values(
        "id, route, route_documents", "(0::BIGINT, 'page', 'page')", "(1, 'drop', 'drop')", "(2, 'skip_document', 'document')", "(3, 'skip_document', 'document')", "(4, 'drop', 'drop')", "(5, 'page', 'page')",
        "(6, 'drop', 'drop')", "(7, 'empty', 'empty')", "(8, 'empty', 'empty')", "(9, 'drop', 'drop')", "(10, 'page', 'page')",
    ),
    "status_label": "SELECT i AS id, CASE WHEN i & 2 <> 0 THEN 'Session utgången' WHEN i & 1 <> 0 THEN 'Fel' WHEN i & 4 <> 0 THEN 'Oförändrad' WHEN i & 8 <> 0 THEN 'Hämtad (Webbläsare)' ELSE 'Hämtad (Standard)' END AS label FROM range(16) t(i)",
    "save_gate": "SELECT doc_id, length(text) > 50 AS saved, false AS saved_no_text FROM documents",
    "sink_json": """SELECT doc_id, '{"title":"' || source || '","url":"https://site.example/doc/' || doc_id || '","author":""}' AS payload FROM documents WHERE length(text) > 50""",
    "sink_md": "SELECT doc_id, sha256('# ' || source || chr(10) || 'Källa: https://site.example/doc/' || doc_id || chr(10) || chr(10) || text) AS payload_sha256 FROM documents WHERE length(text) > 50",
    "pii_texts": _values(
        "id, pnr, phone", "(0::BIGINT, '[PERSONNUMMER] och [PERSONNUMMER]', '19900101-1234 och 900161+1234')", "(1, 'ring 070-123 45 67 nu', 'ring [TELEFON] nu')", "(2, '+46 (0)8 123 45 67', '[TELEFON]')",
        "(3, '0046 70 1234567', '0046 70 1234567')", "(4, 'inget 123', 'inget 123')", "(5, '9913311234', '9913311234')", "(6, '12345678901234567890', '12345678901234567890')",
    ),
    "md_sections": _values(
        "id, position, heading, text", "(1::BIGINT, 0::BIGINT, 'Huvudinnehåll', 'inled')", "(1, 1, 'A', 'text a')",
        "(1, 2, 'C', 'c1' || chr(10) || 'c2')", "(2, 0, 'Huvudinnehåll', '#utan blank' || chr(10) || 'x')"
    ),
    "md_links": _values(
        "id, md",
        "(1::BIGINT, 'se [a](https://a.se/x) och [b](https://a.se/dir/y.html) [c](https://o.se/) [d](#top) [e](mailto:a@b.se) [f](https://a.se/up?q=1)')",
        "(2, 'inga')"
    ),
    "page_date_cascade": _values(
        "id, published, modified", "(1::BIGINT, '2020-01-01', '3 maj 2021')", "(2, '', '4 juni 2020')",
        "(3, '2019-02-03', '')", "(4, '', '2018-01-02')", "(5, '', 'x')"
    ),
    "doc_filename": """SELECT id, stem || '_' || left(md5(url), 6) || ending AS file_name FROM (VALUES (1::BIGINT, 'https://a.se/f/Rapport%20två.PDF', 'rapport-tva', '.pdf'), (2, 'https://a.se/f/x', 'a-fil', '.docx'), (3, 'https://a.se/', 'dokument', '.pdf')) v(id, url, stem, ending)""",
    "robots_allow": _values("id, allowed", "(1::BIGINT, false)", "(2, true)", "(3, true)", "(4, true)"),
    "robots_pages": f"WITH {PARTS} SELECT page_id, starts_with(path, '/en/12') OR NOT (starts_with(path, '/en/1') OR starts_with(path, '/de/4') OR starts_with(path, '/fr/7')) AS allowed FROM u",
    "robots_sitemaps": _values("site, sitemap, crawl_delay", "('a', 'https://a.se/s1.xml', 7::INTEGER)", "('a', 'https://a.se/s2.xml', 7)"),
    "sitemap_urls": _values("sitemap, position, url", "('https://a.se/1.xml.gz', 0::BIGINT, 'https://a.se/p?x=1&y=2')"),
    "site_settings": _values(
        "name, domain, output_dir, delay, incremental, exclude",
        "('Min Sajt Å', 'www.a.se', 'server_data/min-sajt-a', 0.5::DOUBLE, true, 'spam')"
    ),
}
