"""DuckDB SQL that states the results of corpus queries in another way than the operators."""

from __future__ import annotations

def crc_steps(name: str, keys: str) -> str:
    """Recursive CTE ``name``(key, h, p, c): the CRC register of every key of ``keys`` (key) after p of
    its UTF-8 bytes; the CRC-32 is xor(c, 4294967295) where 2 p = len(h)."""
    byte = "CAST('0x' || substr(h, 2 * p + 1, 2) AS BIGINT)"
    bits = ", ".join(f"xor(x{i} >> 1, 3988292384 * (x{i} & 1)) AS x{i + 1}" for i in range(8))
    return f"""{name}(key, h, p, c) AS (
  SELECT key, hex(encode(key)), 0::BIGINT, 4294967295::BIGINT FROM {keys}
  UNION ALL
  SELECT key, h, p + 1, x8 FROM (SELECT key, h, p, xor(c, {byte}) AS x0, {bits}
                                 FROM {name} WHERE 2 * p < len(h)))"""


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def _runs(texts: str) -> str:
    """(rn, f): all runs of one to three consecutive words of ``texts`` (rn, w list)."""
    word = f"SELECT rn, unnest(w) AS a, generate_subscripts(w, 1) AS i FROM {texts}"
    near = f"""SELECT rn, a, lead(a, 1) OVER q AS b, lead(a, 2) OVER q AS c FROM ({word})
        WINDOW q AS (PARTITION BY rn ORDER BY i)"""
    return (f"SELECT rn, unnest([a, a || ' ' || b, a || ' ' || b || ' ' || c]) AS f FROM ({near})")


OP12 = f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS rn, doc_id, {_WORDS} AS w FROM documents),
df AS (SELECT * FROM ({_runs('d')}) WHERE f IS NOT NULL),
be AS (SELECT row_number() OVER () AS rn, {_WORDS} AS w FROM benchmark),
bf AS (SELECT f FROM ({_runs('be')}) WHERE f IS NOT NULL),
keys AS (SELECT f AS key FROM df UNION SELECT f FROM bf),
{crc_steps('steps', 'keys')},
voc AS (SELECT key AS f, xor(c, 4294967295) % 10000 AS b FROM steps WHERE 2 * p = len(h)),
s AS (SELECT b, count(*) AS s FROM df JOIN voc USING (f) GROUP BY b),
t AS (SELECT b, count(*) AS t FROM bf JOIN voc USING (f) GROUP BY b),
tot AS (SELECT (SELECT count(*) FROM df)::DOUBLE AS all_s, (SELECT count(*) FROM bf)::DOUBLE AS all_t),
g AS (SELECT s.b, CAST(floor(1000 * ln((coalesce(t, 0) + 1.0::DOUBLE) * (all_s + 10000) / ((s + 1.0::DOUBLE) * (all_t + 10000)))) AS BIGINT) AS gain
      FROM s LEFT JOIN t USING (b), tot),
wd AS (SELECT rn, count(*) AS n_features, sum(gain) AS weight FROM df JOIN voc USING (f) JOIN g USING (b) GROUP BY rn),
sc AS (SELECT d.rn, doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features,
         CAST(coalesce(weight, 0) AS BIGINT) AS weight,
         CAST('0x' || substr(sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS h
       FROM d LEFT JOIN wd USING (rn)),
o AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score FROM sc),
r AS (SELECT rn, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST, n_features) AS rank,
        count(*) OVER () AS n FROM o WHERE n_words >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= 5 * n // 100 THEN rank END AS rank
FROM o LEFT JOIN r USING (rn)"""

_BEST = "list_sort(list_filter([{options}], lambda o: o IS NOT NULL))[1]"


def _edits(state: int, to: dict[str, int]) -> str:
    """The cheapest way on from a grammar state over one row, inserts before it left out."""
    then = lambda v, cost, letter: f"{{'c': {v}.c + {cost}, 'a': '{letter}' || {v}.a}}"
    options = [then(f"v{state}", 3, "D")]
    for initial, nxt in to.items():
        options.append(f"CASE WHEN able AND initial = '{initial}' THEN {then(f'v{nxt}', 'cut', 'K')} END")
        if initial != "s":
            options.append(f"CASE WHEN able THEN {then(f'v{nxt}', '2 + cut', 'R')} END")
    return _BEST.format(options=", ".join(options))


_INSERT = "{{'c': {v}.c + 2, 'a': 'I' || {v}.a}}"

OP11 = rf"""
WITH RECURSIVE ids AS (SELECT conv_id, row_number() OVER (ORDER BY conv_id) AS cid FROM (SELECT DISTINCT conv_id FROM conversations)),
raw AS (SELECT cid, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
          concat(coalesce(CAST(c.conv_id AS VARCHAR), ' '), ':', coalesce(CAST(turn AS VARCHAR), ' ')) AS key
        FROM conversations c JOIN ids ON ids.conv_id IS NOT DISTINCT FROM c.conv_id),
keys AS (SELECT DISTINCT key FROM raw),
{crc_steps('steps', 'keys')},
src AS (SELECT raw.*, xor(c, 4294967295) % 20 AS fate FROM raw JOIN steps USING (key) WHERE 2 * p = len(h)),
dmg AS (SELECT cid, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role,
          CASE fate WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
          unnest(range(CASE WHEN fate = 3 THEN 2 ELSE 1 END)) AS copy FROM src WHERE fate <> 0),
ord AS (SELECT *, row_number() OVER (PARTITION BY cid ORDER BY turn NULLS FIRST, role,
            sha256(length(role) || ':' || role || text), copy) AS k,
          rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS kept FROM dmg),
flt AS (SELECT *, substr(role, 1, 1) AS initial, CASE WHEN kept = '' THEN 'blank'
            WHEN row_number() OVER (PARTITION BY cid, role, text ORDER BY k) > 1 THEN 'duplicate'
            WHEN right(kept, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM ord),
prs AS (SELECT *, lag(initial) OVER (PARTITION BY cid ORDER BY k) || initial AS pair FROM flt),
cnt AS (SELECT cid, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
          count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
          count(*) FILTER (fault = 'truncated') AS truncated,
          count(*) FILTER (k > 1 AND pair NOT IN ('su', 'ua', 'au')) AS illegal FROM prs GROUP BY cid),
go(cid, k, v0, v1, v2, v3) AS (
  SELECT cid, n, {{'c': 0, 'a': ''}}, {{'c': 4, 'a': 'II'}}, {{'c': 2, 'a': 'I'}}, {{'c': 0, 'a': ''}} FROM cnt
  UNION ALL
  SELECT cid, k, {_BEST.format(options='c0, ' + _INSERT.format(v='w2'))}, {_BEST.format(options='c1, ' + _INSERT.format(v='w2'))}, w2, w3
  FROM (SELECT *, {_BEST.format(options='c2, ' + _INSERT.format(v='c3'))} AS w2, {_BEST.format(options='c3, ' + _INSERT.format(v='c2'))} AS w3
    FROM (SELECT g.cid, g.k - 1 AS k, fault NOT IN ('blank', 'duplicate') AS able,
            CASE WHEN fault = 'truncated' THEN 1 ELSE 0 END AS cut, initial, v0, v1, v2, v3,
            {_edits(0, {'s': 1, 'u': 2})} AS c0, {_edits(1, {'u': 2})} AS c1,
            {_edits(2, {'a': 3})} AS c2, {_edits(3, {'u': 2})} AS c3
          FROM go g JOIN flt f ON f.cid = g.cid AND f.k = g.k))),
best AS (SELECT cid, v0.c AS cost, v0.a AS audit FROM go WHERE k = 0),
pos AS (SELECT cid, audit, unnest(range(1, length(audit) + 1)) AS p FROM best),
edt AS (SELECT cid, p, substr(audit, p, 1) AS e,
          length(regexp_replace(substr(audit, 1, p), 'I', '', 'g')) AS k,
          length(regexp_replace(substr(audit, 1, p), 'D', '', 'g')) AS place,
          length(regexp_replace(audit, 'D', '', 'g')) AS total FROM pos),
rep AS (SELECT e.cid, string_agg(CASE WHEN e.e = 'K' THEN f.role WHEN (place + total) % 2 = 1 THEN 'user'
            ELSE 'assistant' END || ':' || CASE WHEN e.e = 'I' THEN '' ELSE f.text END, chr(10) ORDER BY p) AS whole
        FROM edt e LEFT JOIN flt f ON f.cid = e.cid AND f.k = e.k AND e.e <> 'I' WHERE e.e <> 'D' GROUP BY e.cid)
SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
  coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(coalesce(cost, 0) AS BIGINT) AS cost,
  coalesce(audit, '') AS audit, sha256(coalesce(whole, '')) AS repaired_sha256
FROM ids LEFT JOIN cnt USING (cid) LEFT JOIN best USING (cid) LEFT JOIN rep USING (cid)"""
