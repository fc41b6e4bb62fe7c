"""DuckDB SQL for the queries of this subpackage that SQL can express, over the whole tables.

Mixing, tokenizers, learned scores and tilings are tested against brute force instead; edit similarity of all lines with
all others would be too slow.
"""

from __future__ import annotations

from quern.llm import chat, codes, licenses, neardup, quality, retrieval, substrings

WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def substring_dedup() -> str:
    n = substrings.THRESHOLD
    return f"""
with docs as (select doc_id, hex(encode(coalesce(text, ''))) as h from documents),
strings as (select doc_id, unnest(range(0, length(h) // 2 - {n - 1})) as p, h from docs where length(h) >= {2 * n}),
named as (select doc_id, p, md5(substring(h, 2 * p + 1, {2 * n})) as s from strings),
gone as (select doc_id, p from (select doc_id, p, row_number() over (partition by s order by doc_id, p) as k from named) where k > 1),
opened as (select doc_id, p, coalesce(p - lag(p) over (partition by doc_id order by p) > {n}, true) as opens from gone),
numbered as (select doc_id, p, sum(opens::int) over (partition by doc_id order by p) as g from opened),
spans as (select doc_id, g, min(p) as a, max(p) + {n} as b from numbered group by all),
cuts as (select doc_id, list(a order by a) as a, list(b order by a) as b, count(*) as n_spans, sum(b - a) as n_removed from spans group by doc_id),
whole as (select doc_id, h, coalesce(a, []) as a, coalesce(b, []) as b, coalesce(n_spans, 0) as n_spans, coalesce(n_removed, 0) as n_removed from docs left join cuts using (doc_id))
select doc_id, (length(h) // 2)::bigint as n_bytes, n_removed::bigint as n_removed, n_spans::bigint as n_spans,
  sha256(unhex(array_to_string(list_transform(range(0, len(a) + 1), lambda i:
    substring(h, case when i = 0 then 1 else 2 * b[i] + 1 end,
      case when i = len(a) then length(h) else 2 * a[i + 1] end - case when i = 0 then 0 else 2 * b[i] end)), ''))) as kept_sha256
from whole"""


def quality_rules() -> str:
    stops = ", ".join(quoted(f) for x in sorted(set(quality.STOP_WORDS)) for f in (x, x.capitalize()))
    rules = []
    for r in quality.RULES:
        top, bottom = (x.strip() for x in r.measure.split("/"))
        ratio = f"case when {bottom} > 0 then {top}::double / {bottom} else 0.0 end"
        rules += [f"{ratio} >= {r.low}"] if r.low is not None else []
        rules += [f"{ratio} <= {r.high}"] if r.high is not None else []
    size = quality.WINDOW
    return rf"""
with docs as (select row_number() over () as rid, doc_id, coalesce(text, '') as t from documents),
split as (select rid, doc_id, t, regexp_extract_all(t, '{WORD}') as w,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{WORD}')) as ln from docs),
grams as (select rid, i, w[i : i + {size - 1}] as g from (select rid, w, unnest(range(1, len(w) - {size - 2})) as i from split where len(w) >= {size})),
twice as (select rid, i from (select rid, i, count(*) over (partition by rid, g) as n from grams) where n > 1),
covered as (select rid, count(distinct p) as n from (select rid, unnest(range(i, i + {size})) as p from twice) group by rid),
counts as (select doc_id, len(w) as n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) as word_chars,
  len(regexp_extract_all(t, '[#*$%&|<>]')) as n_symbols, len(ln) as n_lines, len(ln) - len(list_distinct(ln)) as n_dup_lines,
  coalesce(c.n, 0) as n_repeat_words, len(list_filter(w, lambda x: x in ({stops}))) as n_stop,
  len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i - 1])) as n_stutter,
  len(regexp_extract_all(t, '\p{{Lu}}')) as n_upper, len(regexp_extract_all(t, '[!|]')) as n_marks
  from split left join covered c using (rid)),
judged as (select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed from counts)
select doc_id, n_words::bigint as n_words, word_chars::bigint as word_chars, n_symbols::bigint as n_symbols, n_dup_lines::bigint as n_dup_lines,
  n_repeat_words::bigint as n_repeat_words, base_failed, not base_failed and {" and ".join(rules)} as kept
from judged"""


def license_scan() -> str:
    k, slack = licenses.K, licenses.SLACK
    rows = ", ".join(f"({i}, {quoted(t.label)}, {t.base}, string_split({quoted(t.words)}, ' '))" for i, t in enumerate(licenses.TEMPLATES))
    return rf"""
with docs as (select row_number() over () as rid, doc_id,
  regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
templates as (select * from (values {rows}) v(template, label, base, w)),
places as (select template, label, base, len(w) - {k - 1} as n, t - 1 as t, w[t : t + {k - 1}] as g
  from (select *, unnest(range(1, len(w) - {k - 2})) as t from templates)),
grams as (select rid, p - 1 as p, w[p : p + {k - 1}] as g from (select rid, w, unnest(range(1, len(w) - {k - 2})) as p from docs where len(w) >= {k})),
votes as (select rid, template, label, base, n, p, t, p - t as d from grams join places using (g)),
opened as (select *, coalesce(d - lag(d) over each > case when base then 0 else {slack} end, true) as opens from votes window each as (partition by rid, template order by d)),
numbered as (select *, sum(opens::int) over (partition by rid, template order by d) as grp from opened),
merged as (select rid, template, label, base, n, grp, count(distinct t) as matched, min(p) as first, max(p) + {k - 1} as last from numbered group by all),
sound as (select rid, label, base, first, matched / n as cover from merged
  where case when base then matched = n else matched >= {licenses.COVER} * n and last - first < {licenses.STRETCH} * (n + {k - 1}) end),
ranked as (select *, max(cover) over (partition by rid, base order by first range between {slack} preceding and {slack} following) as best from sound),
found as (select rid, count(*) filter (base) as n_base, min(first) filter (base) as first_word, max(first) filter (base) as last_word,
  array_to_string(list_sort(list(distinct label) filter (base)), ',') as base_labels, array_to_string(list_sort(list(distinct label)), ',') as labels, max(cover) as score
  from ranked where base or cover = best group by rid)
select doc_id, len(w)::bigint as n_words, coalesce(n_base, 0)::bigint as n_base, first_word::bigint as first_word, last_word::bigint as last_word,
  coalesce(base_labels, '') as base_labels, coalesce(labels, '') as labels, coalesce(score, 0.0)::double as score
from docs left join found using (rid)"""


def chat_formatting() -> str:
    said = quoted(chat.END + chat.START + "assistant ok")
    marks = len(chat.START) + len(chat.END) + 2
    return rf"""
with rows as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select * from (values (-1, 0, 'user', {said}), (-1, 1, '{chat.TRAINED}', {said})) v(conv_id, turn, role, text)),
told as (select *, regexp_matches(role || ' ' || text, '<\|im_start\|>|<\|im_end\|>|<\\+\|') or contains(role, chr(10)) or contains(role, '<|n|>') as unsafe from rows),
sized as (select *, length(role) + length(text) + {marks} + case when unsafe then len(regexp_extract_all(role, '<\\*\|')) + len(regexp_extract_all(text, '<\\*\|'))
  + {len("<|n|>") - 1} * len(regexp_extract_all(role, '\n')) else 0 end as chars from told)
select conv_id, count(*)::bigint as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  coalesce(sum(length(text)) filter (role = '{chat.TRAINED}'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = '{chat.TRAINED}'), '')) as loss_sha256, sum(chars)::bigint as formatted_chars
from sized group by conv_id"""


def near_duplicates() -> str:
    width = 5
    return rf"""
with recursive docs as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') as w from documents),
shingles as (select distinct doc_id, md5(array_to_string(w[i : i + {width - 1}], ' ')) as s
  from (select doc_id, w, unnest(range(1, greatest(len(w) - {width - 2}, 2))) as i from docs where len(w) > 0)),
sizes as (select doc_id, count(*) as n from shingles group by doc_id),
shared as (select a.doc_id as a, b.doc_id as b, count(*) as n from shingles a join shingles b on a.s = b.s and a.doc_id < b.doc_id group by all),
links as (select a, b from shared join sizes x on x.doc_id = a join sizes y on y.doc_id = b where 100 * shared.n >= {neardup.PERCENT} * (x.n + y.n - shared.n)),
both_ways as (select a, b from links union all select b, a from links),
reached(doc_id, other) as (select a, a from both_ways union select r.doc_id, e.b from reached r join both_ways e on e.a = r.other),
least as (select doc_id, min(other) as component_id from reached group by doc_id)
select doc_id, coalesce(n, 0)::bigint as n_shingles, coalesce(component_id, doc_id) as component_id, coalesce(component_id, doc_id) = doc_id as kept
from docs left join sizes using (doc_id) left join least using (doc_id)"""


def vector_codes() -> str:
    """The width of a part is that of the tables at hand: 64 components in 16 parts."""
    scale, entries, parts = codes.SCALE, codes.ENTRIES, codes.PARTS
    xs = [f"x{k}" for k in range(1, 5)]
    apart = " + ".join(f"(a.{x} - b.{x}) * (a.{x} - b.{x})" for x in xs)
    # sum less its positive remainder divides evenly: the quotient rounded down
    means = ", ".join(f"((sum(a.{x}) - (sum(a.{x}) % count(*) + count(*)) % count(*)) // count(*))::bigint as {x}" for x in xs)
    rounds = "".join(f""",
near{r} as (select rid, a.p, min(({apart}) * {entries} + b.k) as m from parts a join book{r} b on a.p = b.p group by rid, a.p)"""
        + (f""",
means{r} as (select p, m % {entries} as k, {means} from parts a join near{r} using (rid, p) group by p, m % {entries}),
book{r + 1} as (select b.p, b.k, {", ".join(f"coalesce(n.{x}, b.{x}) as {x}" for x in xs)} from book{r} b left join means{r} n using (p, k))""" if r < codes.ROUNDS else "")
        for r in range(codes.ROUNDS + 1))
    return f"""
with kept as (select row_number() over (order by vec_id) as rid, vec_id, label, list_transform(embedding, lambda x: floor(x::double * {scale})::bigint) as v from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
cuts as (select rid, unnest(range({parts})) as p, v from kept),
parts as (select rid, p, {", ".join(f"v[4 * p + {k}] as {x}" for k, x in enumerate(xs, 1))} from cuts),
book0 as (select p, rid - 1 as k, {", ".join(xs)} from parts where rid <= {entries}){rounds},
coded as (select rid, string_agg(printf('%02x', (m % {entries})::int), '' order by p) as code, sum(m // {entries})::bigint as error from near{codes.ROUNDS} group by rid),
digest as (select sha256(string_agg(concat_ws(',', {", ".join(xs)}), ',' order by p, k)) as codebooks_sha256 from book{codes.ROUNDS})
select vec_id, code, error, sum(error) over (partition by label)::bigint as label_error, codebooks_sha256
from kept join coded using (rid), digest"""


def lexical_search() -> str:
    terms = rf"unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{retrieval.TERM_CLASS}'))"
    return f"""
with said as (select doc_id, {terms} as term from documents),
lengths as (select doc_id, count(*) as n from said group by doc_id),
totals as (select count(*) as docs, sum(n)::bigint as terms from lengths),
tfs as (select doc_id, term, count(*) as tf from said group by doc_id, term),
weights as (select term, floor(1000 * ln((2 * docs + 2) / (2 * df + 1)))::bigint as w from (select term, count(*) as df from tfs group by term), totals),
asked as (select item_id, {terms} as term from benchmark),
scores as (select item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // terms))))::bigint as score
  from asked join weights using (term) join tfs using (term) join lengths using (doc_id), totals group by item_id, doc_id),
ranked as (select item_id, row_number() over (partition by item_id order by score desc, doc_id) as rank, doc_id, score from scores where score > 0)
select item_id, rank::int as rank, doc_id, score from ranked where rank <= {retrieval.K}"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_substring_dedup": substring_dedup(),
        "op2_quality_rules": quality_rules(),
        "op3_license_scan": license_scan(),
        "op4_chat_formatting": chat_formatting(),
        "op6_near_duplicates": near_duplicates(),
        "op12_lexical_search": lexical_search(),
        "op13_vector_codes": vector_codes(),
    }
