"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

from interviewflow.llm import chat, passages, pii, quality, search, secrets

WORD = r"[^\x20\x09-\x0D]+"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def found(text: str, pattern: str, kind: str, rank: int, keep: str = "true") -> str:
    """List of spans of a pattern; ``keep`` is a condition on ``hit``."""
    p = quoted(pattern)
    return (
        f"list_filter((SELECT coalesce(list({{'start': pos + before, 'rank': {rank}, 'end': pos + before + length(hit), "
        f"'kind': '{kind}', 'hit': hit}}), []) FROM (SELECT hits[i] AS hit, "
        f"list_sum(list_transform(gaps[:i], lambda g: length(g)))::BIGINT AS pos, "
        f"coalesce(list_sum(list_transform(hits[:i - 1], lambda h: length(h))), 0)::BIGINT AS before "
        f"FROM (SELECT regexp_extract_all({text}, {p}) AS hits, string_split_regex({text}, {p}) AS gaps), "
        f"unnest(range(1, len(hits) + 1)) AS u(i))), lambda s: {keep.replace('hit', 's.hit')})"
    )


def listed(spans: str) -> str:
    ordered = f"list_sort(list_transform({spans}, lambda s: {{'start': s.start, 'rank': s.rank, 'end': s.end, 'kind': s.kind}}))"
    return f"array_to_string(list_transform({ordered}, lambda s: concat(s.kind, ':', s.start, ':', s.end)), ',')"


def _secrets() -> str:
    key = "(" + "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w) for w in (
        "password", "passwd", "secret", "token", "api_?key")) + ")"
    assign = key + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    base = [
        found("t", assign, "assign", 0, f"length(regexp_extract(hit, {quoted(assign)}, 2)) >= {secrets.ASSIGN_LEAST}"),
        found("t", r"AKIA[A-Z0-9]+", "access", 1, "length(hit) >= 20"),
        found("t", secrets.HEX, "hex", 2),
    ]
    more = []
    shapes = [a for a in secrets.ALLOW if a.startswith("^")]
    words = "|".join(f"(?:{a})" for a in secrets.ALLOW if not a.startswith("^"))

    def shaped(hit: str) -> str:
        return "(" + " OR ".join(f"regexp_matches({hit}, {quoted(a)})" for a in shapes) + ")"

    for i, c in enumerate(secrets.CLASSES):

        def hot(hit: str, k: str) -> str:
            return (
                f"list_filter(range(0, length({hit}) - {c.window} + 1), lambda {k}: "
                f"list_aggregate(string_split(substring({hit}, {k} + 1, {c.window}), ''), 'entropy') >= {c.bits} - 1e-9)"
            )

        near = f"[A-Za-z0-9]{{0,{c.window}}}"
        bare = "regexp_replace(p, '^[+/_=-]+|[+/_=-]+$', '', 'g')"
        parts = f"string_split_regex(x.s.hit, {quoted(f'{near}(?:{words}){near}')})"
        random = f"len(list_filter({parts}, lambda p: NOT {shaped(bare)} AND len({hot('p', 'j')}) > 0)) > 0"
        runs = found("t", c.pattern, c.kind, 3 + i, f"NOT {shaped('hit')}")
        more.append(
            f"list_transform(list_filter(list_transform({runs}, lambda s: {{'s': s, 'hot': {hot('s.hit', 'k')}}}), "
            f"lambda x: len(x.hot) > 0 AND (NOT regexp_matches(x.s.hit, {quoted(words)}) OR {random})), lambda x: "
            f"{{'start': x.s.start + list_min(x.hot), 'rank': x.s.rank, "
            f"'end': x.s.start + list_max(x.hot) + {c.window}, 'kind': x.s.kind, 'hit': ''}})"
        )
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
b AS (SELECT doc_id, t, {base[0]} AS a, {base[1]} AS k, {base[2]} AS h FROM d),
m AS (SELECT *, list_concat({', '.join(more)}) AS e FROM b)
SELECT doc_id, len(a)::BIGINT AS n_assign, len(k)::BIGINT AS n_access, len(h)::BIGINT AS n_hex,
  sha256({listed('list_concat(a, k, h)')}) AS base_sha256, {listed('list_concat(a, k, h, e)')} AS spans FROM m"""


def _pii() -> str:
    number = "regexp_replace(hit, '[^0-9]', '', 'g')"
    luhn = (
        f"(list_sum(list_transform(range(1, length({number}) + 1), lambda i: "
        f"CASE WHEN i % 2 = 1 THEN reverse({number})[i]::INT WHEN reverse({number})[i]::INT > 4 "
        f"THEN 2 * reverse({number})[i]::INT - 9 ELSE 2 * reverse({number})[i]::INT END)) % 10 = 0)"
    )
    parts = f"regexp_full_match(hit, '{pii.IP_PART}([.]{pii.IP_PART}){{3}}')"
    plain = "replace(hit, ' ', '')"
    turned = f"concat(substring({plain}, 5), substring({plain}, 1, 4))"
    alphabet = "'0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ'"
    mod97 = (
        f"(list_reduce(list_transform(string_split({turned}, ''), lambda c: strpos({alphabet}, c) - 1), "
        "lambda r, v: (r * (CASE WHEN v > 9 THEN 100 ELSE 10 END) + v) % 97, 0) = 1)"
    )
    lists = {
        "em": found("t", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "email", 0),
        "ip": found("t", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "ip", 1, parts),
        "ca": found("t", r"[0-9]([\x20-]?[0-9])+", "card", 2, f"length({number}) BETWEEN 12 AND 19 AND {luhn}"),
        "ph": found("t", r"\+[0-9][\x20().0-9-]+[0-9]", "phone", 3, f"length({number}) BETWEEN 9 AND 15"),
        "ib": found("t", pii.IBAN, "iban", 4, mod97),
        "na": found("t", pii.NATIONAL, "national", 5),
    }

    def scored(name: str, kind: str) -> str:
        base, up, down = pii.SCORES[kind]
        around = (
            f"concat(substring(t, greatest(s.start - {pii.NEAR}, 0) + 1, s.start - greatest(s.start - {pii.NEAR}, 0)), ' ', "
            f"substring(t, s.end + 1, {pii.NEAR}))"
        )
        return (
            f"list_filter({name}, lambda s: {base} + (CASE WHEN regexp_matches({around}, {quoted(up)}) THEN {pii.STEP} "
            f"ELSE 0 END) - (CASE WHEN regexp_matches({around}, {quoted(down)}) THEN {pii.STEP} ELSE 0 END) >= {pii.LEAST_SCORE})"
        )

    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
b AS (SELECT doc_id, t, {', '.join(f'{sql} AS {name}' for name, sql in lists.items())} FROM d)
SELECT doc_id, len(em)::BIGINT AS n_email, len(ip)::BIGINT AS n_ip, len(ca)::BIGINT AS n_card,
  len(ph)::BIGINT AS n_phone, sha256({listed('list_concat(em, ip, ca, ph)')}) AS base_sha256,
  {listed(f"list_concat(em, ip, ca, ph, {scored('ib', 'iban')}, {scored('na', 'national')})")} AS spans FROM b"""


def _quality() -> str:
    stop = ", ".join(quoted(w) for w in sorted(set(quality.STOP_WORDS.split())))
    per_word, per_line = "greatest(n_words, 1)", "greatest(n_lines, 1)"
    values = {
        "n_words": "n_words",
        "mean_word_chars": f"word_chars / {per_word}",
        "symbols_per_word": f"n_symbols / {per_word}",
        "stop_word_share": f"n_stop / {per_word}",
        "letter_share": "n_letters / greatest(word_chars, 1)",
        "capitals_share": "n_capitals / greatest(n_letters, 1)",
        "repeat_word_share": f"n_repeat_words / {per_word}",
        "doubled_word_share": f"n_doubled / {per_word}",
        "dup_line_share": f"n_dup_lines / {per_line}",
        "bullet_line_share": f"n_bullets / {per_line}",
        "ellipsis_line_share": f"n_ellipses / {per_line}",
    }
    rules = []
    for name, least, most, words in quality.RULES:
        bounds = [f"{values[name]} >= {least}"] * (least is not None) + [f"{values[name]} <= {most}"] * (most is not None)
        rules.append(f"(n_words < {words} OR ({' AND '.join(bounds)}))")
    k = quality.WINDOW
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
s AS (SELECT r, doc_id, t, regexp_extract_all(t, {quoted(WORD)}) AS w,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, {quoted(WORD)})) AS ln FROM d),
win AS (SELECT r, i, array_to_string(w[i:i + {k - 1}], ' ') AS g FROM s, unnest(range(1, len(w) - {k - 2})) AS u(i)),
twice AS (SELECT r, i FROM win QUALIFY count(*) OVER (PARTITION BY r, g) > 1),
cov AS (SELECT r, count(DISTINCT i + j) AS n FROM twice, unnest(range(0, {k})) AS v(j) GROUP BY r),
m AS (SELECT s.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
  length(regexp_replace(t, '[^{quality.SYMBOLS}]+', '', 'g'))::BIGINT AS n_symbols,
  (len(ln) - len(list_distinct(ln)))::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words,
  len(ln) AS n_lines, len(list_filter(w, lambda x: lower(x) IN ({stop}))) AS n_stop,
  len(list_filter(range(2, len(w) + 1), lambda k: w[k] = w[k - 1])) AS n_doubled,
  length(regexp_replace(t, '[^\\p{{L}}]+', '', 'g')) AS n_letters,
  length(regexp_replace(t, '[^\\p{{Lu}}]+', '', 'g')) AS n_capitals,
  len(list_filter(ln, lambda x: regexp_matches(x, '^\\s*[-*•]'))) AS n_bullets,
  len(list_filter(ln, lambda x: regexp_matches(x, '(?:\\.\\.\\.|…)\\s*$'))) AS n_ellipses
  FROM s LEFT JOIN cov USING (r)),
f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND {' AND '.join(rules)} AS kept FROM f"""


def _chat(probe: str) -> str:
    stride = chat.stride_of()
    escape = "replace(replace(replace({0}, '\\', '\\\\'), '<|', '<\\|'), '|>', '|\\>')"
    shown = f"length(concat('<|', {escape.format('role')}, '|>', chr(10), {escape.format('text')}, '<|end|>', chr(10)))"
    return f"""
WITH c AS (SELECT conv_id, turn, role, text FROM conversations
  UNION ALL SELECT -7, 0, 'user', {quoted(probe)} UNION ALL SELECT -7, 1, 'assistant', {quoted(probe)}),
t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM c),
p AS (SELECT *, len(regexp_extract_all(text, {quoted(chat.TOKEN)})) + {chat.TURN_TOKENS} AS n FROM t),
b AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before, {shown} AS chars FROM p),
s AS (SELECT *, before // {stride} AS span FROM b),
w AS (SELECT conv_id, span, min(before) AS first FROM s GROUP BY ALL),
x AS (SELECT *, lead(first) OVER (PARTITION BY conv_id ORDER BY span) AS next FROM w),
y AS (SELECT conv_id, min(before) AS at, arg_min(chars, before) AS chars FROM s WHERE role = 'system' GROUP BY conv_id),
r AS (SELECT s.conv_id, sum(s.chars) AS chars FROM s JOIN x ON s.conv_id IS NOT DISTINCT FROM x.conv_id AND s.span = x.span
  LEFT JOIN y ON s.conv_id IS NOT DISTINCT FROM y.conv_id
  WHERE x.next - s.before <= {chat.HISTORY} AND s.before IS DISTINCT FROM y.at GROUP BY ALL),
z AS (SELECT x.conv_id, sum(y.chars) AS chars FROM x JOIN y ON x.conv_id IS NOT DISTINCT FROM y.conv_id
  WHERE x.first > y.at GROUP BY ALL),
g AS (SELECT conv_id, count(*) AS n_turns,
  string_agg(concat(role, chr(10), text, chr(10)), '' ORDER BY before) AS whole,
  coalesce(string_agg(text, '' ORDER BY before) FILTER (role = 'assistant'), '') AS loss, sum(chars) AS own FROM s GROUP BY conv_id)
SELECT g.conv_id, n_turns::BIGINT AS n_turns, sha256(whole) AS turns_sha256, length(loss)::BIGINT AS loss_chars,
  sha256(loss) AS loss_sha256, (own + coalesce(r.chars, 0) + coalesce(z.chars, 0))::BIGINT AS formatted_chars
FROM g LEFT JOIN r ON g.conv_id IS NOT DISTINCT FROM r.conv_id LEFT JOIN z ON g.conv_id IS NOT DISTINCT FROM z.conv_id"""


def _passages() -> str:
    k = passages.LEAST
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), {quoted(WORD)}) AS w FROM documents),
v AS (SELECT r, doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d),
win AS (SELECT r, doc_id, i, array_to_string(w[i:i + {k - 1}], ' ') AS g FROM d, unnest(range(1, len(w) - {k - 2})) AS u(i)),
late AS (SELECT r, i FROM win QUALIFY min(doc_id) OVER (PARTITION BY g) < doc_id),
gone AS (SELECT DISTINCT r, i + j AS i FROM late, unnest(range(0, {k})) AS u(j)),
kept AS (SELECT r, string_agg(word, ' ' ORDER BY i) AS rest, count(*) AS n FROM v ANTI JOIN gone USING (r, i) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(rest, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (r)"""


def _search() -> str:
    letters = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ'"
    term = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

    def terms(text: str) -> str:
        return f"regexp_extract_all(translate(coalesce({text}, ''), {letters}, lower({letters})), {quoted(term)})"

    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {terms('text')} AS w FROM documents),
s AS (SELECT count(*) FILTER (len(w) > 0) AS n, sum(len(w))::BIGINT AS l FROM d),
f AS (SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(w) AS t FROM d) GROUP BY ALL),
c AS (SELECT t, floor(1000 * ln((2 * any_value(n) + 2) / (2 * count(*) + 1)))::BIGINT AS weight FROM f, s GROUP BY t),
m AS (SELECT r, doc_id, 100 - 75 + ((75 * len(w) * n) // l) AS m FROM d, s WHERE len(w) > 0),
q AS (SELECT b, item_id, t, count(*) AS n FROM (SELECT b, item_id, unnest(w) AS t
  FROM (SELECT row_number() OVER () AS b, item_id, {terms('text')} AS w FROM benchmark)) GROUP BY ALL),
x AS (SELECT b, item_id, doc_id, r, sum(q.n * weight * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
  FROM q JOIN c USING (t) JOIN f USING (t) JOIN m USING (r) GROUP BY ALL)
SELECT item_id, row_number() OVER (PARTITION BY b ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM x
WHERE score > 0 QUALIFY rank <= {search.BEST}"""


def oracles(probe: str) -> dict[str, str]:
    return {
        "op11_passages": _passages(),
        "op12_search": _search(),
        "op1_secrets": _secrets(),
        "op7_quality": _quality(),
        "op8_pii": _pii(),
        "op9_chat": _chat(probe),
    }
