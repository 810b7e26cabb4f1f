"""DuckDB twins of the data-preparation queries that SQL can express.

The others (edit distances, control charts, format mixtures, grammars) are held
against brute force and known cases in the tests.
"""

from __future__ import annotations

_KEY = "regexp_replace(regexp_replace(upper(trim(X, ' ')), '^HIERARCH\\s+', ''), '[^A-Z0-9]', '', 'g')"
_CARDS = f"""al AS (SELECT DISTINCT {_KEY.replace('X', 'card')} AS k, field_name FROM card_aliases WHERE field_name IN ('det_temp', 'eq_mode', 'bayer_pattern')),
 c AS (SELECT r.header_id, r.device_id, r.session_id, e.key AS card, CASE e.type WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'ARRAY' THEN 'array' WHEN 'OBJECT' THEN 'object' WHEN 'NULL' THEN NULL ELSE 'number' END AS kind FROM raw_headers r, json_each(r.cards) e),
 t AS (SELECT c.*, al.field_name FROM c JOIN al ON al.k = {_KEY.replace('X', 'c.card')})"""

#: Sessions with cards and carried types per field, their fingerprint and the number of their version.
_VERSIONS = f"""{_CARDS}, s AS (SELECT device_id, session_id, min(night) AS since FROM raw_headers WHERE device_id IS NOT NULL AND session_id IS NOT NULL GROUP BY ALL),
 f AS (SELECT unnest(['det_temp', 'eq_mode', 'bayer_pattern']) AS field_name, unnest([0, 1, 2]) AS o),
 st AS (SELECT device_id, session_id, field_name, string_agg(DISTINCT card, '|' ORDER BY card) AS card, string_agg(DISTINCT kind, '|' ORDER BY kind) AS kind FROM t GROUP BY ALL),
 g AS (SELECT s.*, f.field_name, f.o, st.card, last_value(st.kind IGNORE NULLS) OVER (PARTITION BY s.device_id, f.field_name ORDER BY since, s.session_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS kind FROM s CROSS JOIN f LEFT JOIN st ON st.device_id = s.device_id AND st.session_id = s.session_id AND st.field_name = f.field_name),
 p AS (SELECT device_id, session_id, since, substr(sha256(coalesce(string_agg(CASE WHEN card IS NOT NULL THEN concat_ws(':', field_name, card, coalesce(kind, 'null')) END, ';' ORDER BY o), '')), 1, 16) AS fingerprint FROM g GROUP BY ALL),
 b AS (SELECT *, coalesce(fingerprint <> lag(fingerprint) OVER w, true) AS begins, lag(fingerprint) OVER w IS NULL AS base FROM p WINDOW w AS (PARTITION BY device_id ORDER BY since, session_id)),
 v AS (SELECT *, (sum(begins::INT) OVER (PARTITION BY device_id ORDER BY since, session_id ROWS UNBOUNDED PRECEDING))::INT AS version FROM b)"""

# The codes and words of the operator's cast rules.
_MOUNTS = "MAP {'0': 0, '1': 1, 'az': 0, 'eq': 1, 'altaz': 0, 'alt-az': 0, 'azimuthal': 0, 'equatorial': 1, 'true': 1, 'false': 0, 't': 1, 'f': 0}"
_CODES = "MAP {'0': 'RGGB', '1': 'GRBG', '2': 'BGGR', '3': 'GBRG'}"

_BAD = "(X IS NULL OR isnan(X) OR X <= 0)"

SQL: dict[str, str] = {
    "p1_found": f"""WITH {_CARDS}, s AS (SELECT device_id, session_id, min(night) AS night FROM raw_headers GROUP BY ALL), f AS (SELECT unnest(['det_temp', 'eq_mode', 'bayer_pattern']) AS field_name),
 st AS (SELECT session_id, field_name, string_agg(DISTINCT card, '|' ORDER BY card) AS card, string_agg(DISTINCT kind, '|' ORDER BY kind) AS kind FROM t GROUP BY ALL),
 g AS (SELECT s.device_id, s.session_id, s.night, f.field_name, st.card, st.kind FROM s CROSS JOIN f LEFT JOIN st ON st.session_id = s.session_id AND st.field_name = f.field_name),
 l AS (SELECT *, lag(card) OVER w AS was, last_value(kind IGNORE NULLS) OVER (PARTITION BY device_id, field_name ORDER BY night, session_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS known, row_number() OVER w AS n FROM g WINDOW w AS (PARTITION BY device_id, field_name ORDER BY night, session_id)),
 x AS (SELECT * FROM l WHERE n > 1)
 SELECT device_id, session_id, field_name, 'added' AS change_kind FROM x WHERE was IS NULL AND card IS NOT NULL UNION ALL SELECT device_id, session_id, field_name, 'removed' FROM x WHERE was IS NOT NULL AND card IS NULL
 UNION ALL SELECT device_id, session_id, field_name, 'renamed' FROM x WHERE was <> card UNION ALL SELECT device_id, session_id, field_name, 'retyped' FROM x WHERE was IS NOT NULL AND card IS NOT NULL AND kind <> known""",
    "p1_migrations": f"""WITH {_VERSIONS}, l AS (SELECT g.*, lag(card) OVER w AS was, lag(kind) OVER w AS known FROM g WINDOW w AS (PARTITION BY device_id, field_name ORDER BY since, session_id)),
 h AS (SELECT l.*, v.base, unnest([CASE WHEN base AND card IS NOT NULL THEN 'base' END, CASE WHEN NOT base AND was IS NULL AND card IS NOT NULL THEN 'added' END, CASE WHEN was IS NOT NULL AND card IS NULL THEN 'removed' END,
  CASE WHEN was <> card THEN 'renamed' END, CASE WHEN was IS NOT NULL AND card IS NOT NULL AND kind <> known THEN 'retyped' END, CASE WHEN was IS NOT NULL AND card IS NOT NULL AND kind IS NOT NULL AND known IS NULL THEN 'typed' END]) AS k, unnest([1, 2, 3, 4, 5, 6]) AS i
  FROM l JOIN v USING (device_id, session_id) WHERE v.begins),
 m AS (SELECT device_id, session_id, string_agg(concat_ws(' ', k, field_name, coalesce(was, '-') || ' -> ' || coalesce(card, '-'), coalesce(known, '-') || ' -> ' || coalesce(CASE WHEN card IS NOT NULL THEN kind END, '-')), '; ' ORDER BY o, i) AS steps FROM h WHERE k IS NOT NULL GROUP BY ALL)
 SELECT v.device_id, version, min(fingerprint) AS fingerprint, max(CASE WHEN begins THEN v.session_id END) AS first_session, min(since) AS first_seen, max(since) AS last_seen, count(*) AS sessions, coalesce(max(CASE WHEN begins THEN steps END), '') AS steps
 FROM v LEFT JOIN m USING (device_id, session_id) GROUP BY v.device_id, version""",
    "p1_table": f"""WITH {_VERSIONS}, x AS (SELECT t.*, trim(e.value ->> '$') AS txt FROM t JOIN raw_headers r USING (header_id), json_each(r.cards) e WHERE e.key = t.card),
 y AS (SELECT *, CASE field_name WHEN 'det_temp' THEN nullif(regexp_extract(txt, '^([+-]?[0-9]*\\.?[0-9]+(?:[eE][+-]?[0-9]+)?)\\s*(?:°\\s*)?[Cc]?$', 1), '')
   WHEN 'eq_mode' THEN ({_MOUNTS})[regexp_replace(lower(txt), '\\.0+$', '')]::VARCHAR
   ELSE CASE WHEN kind = 'number' THEN ({_CODES})[regexp_replace(lower(txt), '\\.0+$', '')] ELSE coalesce(({_CODES})[upper(regexp_replace(txt, '[^A-Za-z0-9]', '', 'g'))], CASE WHEN regexp_full_match(upper(regexp_replace(txt, '[^A-Za-z0-9]', '', 'g')), '[RGB]{{4}}') THEN upper(regexp_replace(txt, '[^A-Za-z0-9]', '', 'g')) END) END END AS val FROM x),
 z AS (SELECT *, row_number() OVER (PARTITION BY header_id, field_name ORDER BY val IS NULL, card) AS n, CASE field_name WHEN 'det_temp' THEN 'DET-TEMP' WHEN 'eq_mode' THEN 'EQMODE' ELSE 'BAYERPAT' END AS std, CASE field_name WHEN 'bayer_pattern' THEN 'string' ELSE 'number' END AS plain FROM y),
 a AS (SELECT header_id, max(CASE WHEN n = 1 AND field_name = 'det_temp' THEN val END)::DOUBLE AS det_temp, max(CASE WHEN n = 1 AND field_name = 'eq_mode' THEN val END)::INT AS eq_mode, max(CASE WHEN n = 1 AND field_name = 'bayer_pattern' THEN val END) AS bayer_pattern,
  string_agg(DISTINCT concat_ws(':', field_name, card, coalesce(kind, 'null')), ';' ORDER BY concat_ws(':', field_name, card, coalesce(kind, 'null'))) AS sig FROM z GROUP BY 1),
 r AS (SELECT header_id, min(device_id) AS device_id, min(session_id) AS session_id FROM raw_headers WHERE header_id IS NOT NULL GROUP BY 1),
 w AS (SELECT header_id, unnest([CASE WHEN card <> std THEN 'rename ' || card || ' -> ' || field_name END, CASE WHEN kind <> plain THEN 'cast ' || field_name || ' from ' || kind END, CASE WHEN kind IS NULL THEN 'null ' || field_name END, CASE WHEN val IS NULL AND kind IS NOT NULL THEN 'reject ' || field_name || ' = ' || txt END]) AS step FROM z
  UNION SELECT r.header_id, 'default ' || f.field_name || CASE WHEN g.card IS NOT NULL THEN ' = null, not in this dump' ELSE ' = null' END FROM r CROSS JOIN f LEFT JOIN g ON g.device_id = r.device_id AND g.session_id = r.session_id AND g.field_name = f.field_name WHERE NOT EXISTS (SELECT 1 FROM z WHERE z.header_id = r.header_id AND z.field_name = f.field_name)),
 q AS (SELECT header_id, string_agg(DISTINCT step, '; ' ORDER BY step) AS steps FROM w WHERE step IS NOT NULL GROUP BY 1)
 SELECT r.header_id, det_temp, eq_mode, bayer_pattern, v.version, substr(sha256(coalesce(sig, '')), 1, 16) AS fingerprint, coalesce(steps, '') AS steps FROM r LEFT JOIN a USING (header_id) LEFT JOIN q USING (header_id) LEFT JOIN v ON v.device_id = r.device_id AND v.session_id = r.session_id""",
    "p1_versions": f"""WITH {_CARDS}, q AS (SELECT header_id, string_agg(DISTINCT concat_ws(':', field_name, card, coalesce(kind, 'null')), ';' ORDER BY concat_ws(':', field_name, card, coalesce(kind, 'null'))) AS sig FROM t GROUP BY 1),
 p AS (SELECT substr(sha256(coalesce(sig, '')), 1, 16) AS fingerprint, night FROM raw_headers LEFT JOIN q USING (header_id)), n AS (SELECT fingerprint, count(*) AS dumps, min(night) AS first_seen, max(night) AS last_seen FROM p GROUP BY 1)
 SELECT fingerprint, row_number() OVER (ORDER BY first_seen, fingerprint) AS version, dumps, first_seen, last_seen FROM n""",
    # Values of a group don't differ in these tables, so any known one is the nearest.
    "p4_found": f"""WITH f AS (SELECT DISTINCT frame_id, session_id, device_id, xbinning, xpixsz, focallen, gain, exptime FROM frames WHERE frame_type = 'light'),
 g AS (SELECT session_id, exptime, max(gain) AS v FROM f WHERE gain >= 0 AND exptime IS NOT NULL GROUP BY ALL),
 x AS (SELECT session_id, max(xpixsz) AS v FROM f WHERE NOT {_BAD.replace('X', 'xpixsz')} GROUP BY ALL), xd AS (SELECT device_id, xbinning, max(xpixsz) AS v FROM f WHERE NOT {_BAD.replace('X', 'xpixsz')} GROUP BY ALL),
 l AS (SELECT session_id, max(focallen) AS v FROM f WHERE NOT {_BAD.replace('X', 'focallen')} GROUP BY ALL), ld AS (SELECT device_id, max(focallen) AS v FROM f WHERE NOT {_BAD.replace('X', 'focallen')} GROUP BY ALL),
 o AS (SELECT frame_id, 'gain' AS field_name, g.v::DOUBLE AS v FROM f JOIN g USING (session_id, exptime) WHERE gain IS NULL OR gain < 0
  UNION ALL SELECT frame_id, 'xpixsz', coalesce(x.v, xd.v) FROM f LEFT JOIN x USING (session_id) LEFT JOIN xd USING (device_id, xbinning) WHERE {_BAD.replace('X', 'xpixsz')}
  UNION ALL SELECT frame_id, 'focallen', coalesce(l.v, ld.v) FROM f LEFT JOIN l USING (session_id) LEFT JOIN ld USING (device_id) WHERE {_BAD.replace('X', 'focallen')})
 SELECT frame_id, field_name, round(v * 1000)::BIGINT AS value_milli FROM o WHERE v IS NOT NULL""",
    "p5_explicit": """SELECT DISTINCT frame_id, CASE WHEN date_obs_card LIKE '%Z' THEN epoch(left(date_obs_card, 19)::TIMESTAMP)::BIGINT WHEN length(date_obs_card) = 13 THEN date_obs_card::BIGINT // 1000 ELSE date_obs_card::BIGINT END AS utc_second
 FROM frames WHERE regexp_full_match(date_obs_card, '\\d{4}-\\d{2}-\\d{2}T\\d{2}:\\d{2}:\\d{2}(\\.\\d+)?Z|\\d{10}|\\d{13}')""",
    # What is no instant in these tables: no card, a blank one, placeholder words and the date of zeros.
    "p5_unread": """SELECT DISTINCT frame_id, CASE WHEN date_obs_card IS NULL THEN 'no_text' WHEN trim(date_obs_card) = '' THEN 'blank' WHEN date_obs_card LIKE '0000-00-00%' THEN 'no_such_date' ELSE 'no_format' END AS reason
 FROM frames WHERE date_obs_card IS NULL OR trim(date_obs_card) = '' OR date_obs_card LIKE '0000-00-00%' OR NOT regexp_matches(date_obs_card, '\\d')""",
    "p3_limits": """SELECT DISTINCT frame_id, 'ccd_temp' AS field_name FROM frames WHERE frame_type = 'light' AND NOT isnan(ccd_temp) AND (ccd_temp < -100 OR ccd_temp > 80)
 UNION ALL SELECT DISTINCT frame_id, 'exptime' FROM frames WHERE frame_type = 'light' AND NOT isnan(exptime) AND (exptime < 1e-6 OR exptime > 86400)""",
    "p6_simple": """WITH b AS (SELECT DISTINCT entry_id, aliases FROM (SELECT entry_id, aliases FROM target_cache UNION ALL SELECT entry_id, aliases FROM cache_entries) WHERE regexp_full_match(aliases, '[A-Za-z0-9 ]*[A-Za-z0-9](?: ?; ?[A-Za-z0-9 ]*[A-Za-z0-9])+')),
 s AS (SELECT entry_id, unnest(string_split(aliases, ';')) AS n, generate_subscripts(string_split(aliases, ';'), 1) AS i FROM b), t AS (SELECT entry_id, trim(n) AS alias_text, i FROM s WHERE trim(n) <> '')
 SELECT entry_id, row_number() OVER (PARTITION BY entry_id ORDER BY i)::INTEGER AS pos, alias_text FROM t""",
}
