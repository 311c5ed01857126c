"""DuckDB SQL of the index and the search: named parts, put together with what each needs."""

from __future__ import annotations

import re

from tessera.functions import lexicon as L


def quoted(*words: str) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def values(rows: list[tuple], *columns: str) -> str:
    def one(x) -> str:
        return quoted(x) if isinstance(x, str) else "null" if x is None else str(x)

    return f"select * from (values {', '.join('(' + ', '.join(map(one, r)) + ')' for r in rows)}) as t({', '.join(columns)})"


def expanded(x: str) -> str:
    out = f"regexp_replace({x}, '\\b({'|'.join(L.NEGATED)})n''t\\b', ' \\1 not ', 'g')"
    for stem, word in L.NEGATED_IRREGULAR:
        out = f"regexp_replace({out}, '\\b{stem}n''t\\b', ' {word} not ', 'g')"
    return out


def lowered(x: str) -> str:
    return f"lower(regexp_replace({x}, '^\\s+|\\s+$', '', 'g'))"


def without_decimals(x: str) -> str:
    """RE2 has no look-around: dotted chains are shielded first."""
    shielded = f"regexp_replace({x}, '(\\d)\\.(\\d+)\\.(\\d)', '\\1' || chr(1) || '\\2' || chr(1) || '\\3', 'g')"
    return f"replace(regexp_replace({shielded}, '(^|\\s)\\d+\\.\\d+\\b', '\\1', 'g'), chr(1), '.')"


TOKEN = r"\d+(?:\.\d+)|\d+(?:,\d{3})*|''(?:s|ve|ll|m|re|d|t)\b|[.?!'']|(?:[a-z]\.)+|[\p{L}\p{N}_]+"


def tokens(x: str) -> str:
    return f"regexp_extract_all({x}, '{TOKEN}')"


def term(tok: str, before: str) -> str:
    tails = quoted(*(f"'{t}" for t in L.TAILS if t != "s"))
    return f"""nullif(case when {tok} in ({quoted(*L.MARKS)}) then null
  when {tok} = '''s' then case when {before} in ({quoted(*L.PRONOUNS)}) then 's' end
  when {tok} in ({tails}) then substr({tok}, 2)
  when regexp_matches({tok}, '^\\d+\\.\\d+$') then null
  when contains({tok}, '.') then replace({tok}, '.', '')
  when regexp_matches({tok}, '^[\\d,]+$') then replace({tok}, ',', '')
  else {tok} end, '')"""


def bucket(t: str) -> str:
    return f"case when regexp_matches({t}, '^[0-9a-z]') then substr({t}, 1, 1) else '_other' end"


def stop(t: str) -> str:
    return f"{t} in ({quoted(*L.STOPWORDS)})"


def irregular(t: str) -> str:
    table = L.IRREGULAR_VERBS | L.IRREGULAR_PLURALS
    return f"case {t} " + " ".join(f"when '{a}' then '{b}'" for a, b in table.items()) + " end"


def without_s(w: str) -> str:
    def base(p: str, b: str) -> str:
        return f"regexp_replace({w}, '{p}', '{b}')" if b else "null"

    return "case " + " ".join(f"when regexp_matches({w}, '{p}') then {base(p, b)}" for p, b in L.S_RULES) + " end"


def lemma(t: str) -> str:
    return f"case when {stop(t)} or regexp_matches({t}, '^[0-9]') then {t} else coalesce({irregular(t)}, {without_s(t)}, {t}) end"


def tag(tok: str, before: str) -> str:
    verbs, plurals = (quoted(*(w for w in table if w not in L.STOPWORDS)) for table in (L.IRREGULAR_VERBS, L.IRREGULAR_PLURALS))
    return f"""case when {tok} in ({quoted(*L.MARKS)}) then '.' when regexp_matches({tok}, '^\\d[\\d.,]*$') then 'CD'
  when {tok} = '''s' then case when {before} in ({quoted(*L.PRONOUNS)}) then 'VBZ' else 'POS' end
  when {tok} in ({verbs}) then 'VBD' when {tok} in ({plurals}) then 'NNS' when regexp_matches({tok}, '^.{{3,}}ing$') then 'VBG'
  when regexp_matches({tok}, '^.{{3,}}ed$') then 'VBD' when regexp_matches({tok}, '^.{{3,}}iest$') then 'JJS' when regexp_matches({tok}, '^.{{3,}}(ous|ful|ive|less|able|ible)$') then 'JJ' when {without_s(tok)} is not null then 'NNS' else 'NN' end"""


def lemma_by_tag(t: str, tag: str) -> str:
    noun = f"coalesce({listed(L.IRREGULAR_PLURALS, t)}, {without_s(t)}, case when {tag} in ('NNS', 'NNPS') and ends_with({t}, 's') and length({t}) > 1 then left({t}, length({t}) - 1) end, {t})"
    return f"case when {stop(t)} or regexp_matches({t}, '^[0-9]') then {t} when {as_verb(t, tag)} then coalesce({listed(L.IRREGULAR_VERBS, t)}, {t}) when {tag} in ({tags_of('n')}) then {noun} else {t} end"


def tags_of(kinds: str) -> str:
    return quoted(*(x for x, c in L.TAG_CLASSES.items() if c in kinds))


def listed(forms: dict[str, str], t: str) -> str:
    return f"case {t} " + " ".join(f"when '{a}' then '{b}'" for a, b in forms.items()) + " end"


def as_verb(t: str, tag: str) -> str:
    return f"({tag} in ({tags_of('v')}) or {tag} = 'JJ' or ({tag} = 'NN' and ends_with({t}, 'ing')))"


def verb_bases(t: str, comparatives: bool = False) -> str:
    rules = L.VERB_BASES + (L.COMPARATIVE_BASES if comparatives else ())
    each = ", ".join(f"case when regexp_matches({t}, '{fits}') and regexp_matches({t}, '{p}') then regexp_replace({t}, '{p}', '{b}') end" for fits, p, b in rules)
    return f"list_filter([{each}], lambda x: x is not null)"


def bases_by_tag(t: str, tag: str) -> str:
    return f"case when {stop(t)} then [] when {as_verb(t, tag)} then {verb_bases(t)} when {tag} in ({tags_of('ar')}) then {verb_bases(t, True)} else [] end"


def query_term(w: str) -> str:
    """Of a word without commas: as noun, then as verb by list."""
    return f"case when {stop(w)} or regexp_matches({w}, '^[0-9]') then {w} else coalesce({listed(L.IRREGULAR_PLURALS, w)}, {without_s(w)}, {listed(L.IRREGULAR_VERBS, w)}, {w}) end"


def trims(w: str) -> str:
    each = ", ".join(f"case when ends_with({w}, '{a}') then left({w}, length({w}) - {len(a)}) || '{b}' end" for a, b in L.TRIMS)
    return f"case when length({w}) >= 4 then list_distinct(list_filter([{each}], lambda x: x is not null)) else [] end"


def surface_list(t: str) -> str:
    plural = [f"case when ends_with({t}, '{base}') then left({t}, length({t}) - {len(base)}) || '{suffix}' end" for suffix, base in L.TRIMS]
    verb = [f"{t} || 'ed'", f"{t} || 'ing'"] + [f"case when ends_with({t}, 'e') then left({t}, length({t}) - 1) || '{x}' end" for x in ("ed", "ing")]
    doubled = [f"case when regexp_matches({t}, '[b-df-hj-np-tv-z]$') then {t} || right({t}, 1) || '{x}' end" for x in ("ed", "ing")]
    return f"list_distinct(list_filter([{', '.join(plural + verb + doubled)}], lambda x: x is not null))"


DELETIONS = "list_distinct(list_concat([{w}], flatten(list_transform([{w}], lambda v: list_transform(range(1, greatest(length(v), 1) + 1), lambda i: substr(v, 1, i - 1) || substr(v, i + 1))))))"

#: The channel's weight orders a word's candidates; both thresholds are in whole numbers.
WEIGHT = "cf * case when edit = 1 then 4 else 1 end desc, edit, cf desc, cand"
OBVIOUS = "case when edit = 1 then cf * 10000000 > sumf * 9375 else cf * 100000 > sumf * 375 end"
NON_OBVIOUS = "case when edit = 1 then 4 * cf > 75 * own else cf > 75 * own end"

PARTS: dict[str, str] = {
    "lines": r"select doc_id, unnest(range(len(ls))) as line_no, unnest(ls) as line from (select doc_id, regexp_split_to_array(text, '\r\n|\n|\r') as ls from documents)",
    "token_lists": f"select doc_id, line_no, {tokens(without_decimals(expanded(lowered('line'))))} as ts from lines",
    "toks": "select doc_id, line_no, unnest(range(len(ts))) as tok_no, unnest(ts) as tok from token_lists",
    "before": "select *, lag(tok) over (partition by doc_id, line_no order by tok_no) as prev from toks",
    "terms": f"select * from (select doc_id, line_no, tok_no, {term('tok', 'prev')} as term from before) where term is not null",
    "positions": f"select doc_id, term, cast(row_number() over (partition by doc_id order by line_no, tok_no) as integer) as pos, cast(line_no as integer) as line_no, {stop('term')} as is_stop, case when {stop('term')} then '_stop' else {bucket('term')} end as bucket from terms",
    "postings": "select term, doc_id, count(*) as tf, is_stop, bucket from positions group by term, doc_id, is_stop, bucket",
    "vocab": "select term, cast(sum(tf) as bigint) as cf, count(*) as df, is_stop, bucket from postings group by term, is_stop, bucket",
    "stats": "select cast(coalesce(sum(cf), 0) as bigint) as sumf from vocab where bucket between 'a' and 'z'",
    "line_ends": "select doc_id, line_no, min(pos) - 1 as start_pos, max(pos) as end_pos from positions group by doc_id, line_no",
    "stored_lines": "select doc_id, cast(l.line_no as integer) as line_no, cast(start_pos as integer) as start_pos, end_pos, line from lines l join line_ends using (doc_id, line_no)",
    "letters": "select term as cand, cf from vocab where not is_stop and bucket between 'a' and 'z' and regexp_matches(term, '^[a-z]+$')",
    "made_surfaces": f"select cand, cf, unnest({surface_list('cand')}) as surface from letters",
    "irregular_surfaces": "select l.cand, l.cf, i.surface from letters l join irregulars i on i.cand = l.cand",
    "irregulars": values([(a, b) for a, b in (L.IRREGULAR_VERBS | L.IRREGULAR_PLURALS).items()], "surface", "cand"),
    "surfaces": "select distinct surface, cand, cf from (select * from made_surfaces where length(surface) >= 4 union all select cand, cf, surface from irregular_surfaces) s where not exists (select 1 from letters l where l.cand = s.surface)",
    # a batch of queries: query_lines is given by the caller
    "query_lists": r"select query_id, list_filter(regexp_split_to_array(lower(regexp_replace(raw, '^\s+|\s+$', '', 'g')), '\s+'), lambda w: w <> '') as w from query_lines",
    "query_flags": "select query_id, coalesce(w[1] = '>', false) as show_lines, case when w[1] = '>' then w[2:] else w end as w from query_lists",
    "words": "select * from plain_words",
    "plain_words": "select query_id, show_lines, cast(slot as integer) as slot, case when regexp_matches(word, '^[0-9]') then replace(word, ',', '') else word end as word from (select query_id, show_lines, unnest(range(len(w))) as slot, unnest(w) as word from query_flags)",
    "spelt": f"select * from words where regexp_matches(word, '^[a-z]+$') and not {stop('word')}",
    "known": "select distinct word as q, cf from spelt join vocab on term = word and not is_stop",
    "unknown": "select distinct word as q from spelt where word not in (select q from known)",
    "near_unknown": "select q, cand, cf, edit from (select q, cand, cf, levenshtein(q, cand) as edit from unknown join letters on abs(length(q) - length(cand)) <= 2 and q <> cand) where edit <= 2",
    "near_forms": "select q, cand, cf, edit from (select q, cand, cf, levenshtein(q, surface) as edit from unknown join surfaces on abs(length(q) - length(surface)) <= 2 and q <> surface and q <> cand) where edit <= 2",
    "obvious_candidates": "select q, cand, cf, min(edit) as edit from (select * from near_unknown union all select * from near_forms) group by q, cand, cf",
    "near_known": "select q, cand, cf, own, edit from (select q, cand, l.cf, k.cf as own, levenshtein(q, cand) as edit from known k join letters l on abs(length(q) - length(cand)) <= 2 and q <> cand) where edit <= 2",
    "obvious_ranked": f"select *, row_number() over (partition by q order by {WEIGHT}) as turn, {OBVIOUS} as passes, max(cast({OBVIOUS} as integer)) over (partition by q) as anyone from obvious_candidates, stats",
    "obvious": "select q, cand, edit, cf, turn, sumf from obvious_ranked where passes or (anyone = 0 and turn = 1)",
    "non_obvious": f"select q, cand, edit, cf, row_number() over (partition by q order by {WEIGHT}) as turn from near_known where {NON_OBVIOUS}",
    "alternatives": "select q, turn, cand as term from obvious union all select q, turn, cand from non_obvious union all select q, 2147483647, q from known union all select q, 1, q from unknown where q not in (select q from obvious)",
    "numbered": "select q, term, row_number() over (partition by q order by turn, term) - 1 as alt_no from alternatives",
    "slots": f"select query_id, slot, cast(alt_no as integer) as alt_no, term from spelt join numbered on q = word union all select query_id, slot, 0, word from words where not (regexp_matches(word, '^[a-z]+$') and not {stop('word')})",
    # the lemmatising index: these take the places of their namesakes in RULES
    "tagged": f"select doc_id, line_no, tok_no, {term('tok', 'prev')} as term, {tag('tok', 'prev')} as tag from before",
    "tagged_terms": "select * from tagged where term is not null",
    "kinds": "select distinct term, tag from tagged_terms",
    "first_lemmas": f"select term, tag, {lemma_by_tag('term', 'tag')} as lemma from kinds",
    "base_lists": f"select term, tag, {bases_by_tag('term', 'tag')} as bs from first_lemmas where term = lemma",
    "tried_bases": "select term, tag, unnest(bs) as base, unnest(range(len(bs))) as turn from base_lists",
    "attested": "select term, tag, min({'turn': turn, 'base': base}).base as verb from tried_bases where base in (select term from kinds) group by term, tag",
    "lemmas": "select f.term, f.tag, coalesce(a.verb, f.lemma) as lemma from first_lemmas f left join attested a on a.term = f.term and a.tag = f.tag",
    "rule_terms": "select doc_id, line_no, tok_no, lemma as term from tagged_terms join lemmas using (term, tag)",
    "rule_words": f"select query_id, show_lines, slot, {query_term('word')} as first, word from plain_words",
    "rule_lists": f"select *, case when first <> word or {stop('word')} or regexp_matches(word, '^[0-9]') then [] else {verb_bases('word', True)} end as bs from rule_words",
    "rule_tried": "select word, unnest(bs) as base, unnest(range(len(bs))) as turn from rule_lists",
    "rule_bases": "select word, min({'turn': turn, 'base': base}).base as base from rule_tried where base in (select term from vocab where not is_stop) group by word",
    "sizes": "select query_id, max(slot) + 1 as n from slots group by query_id",
    "c1": "select query_id, n, [alt_no] as alts, [term] as terms from slots join sizes using (query_id) where slot = 0",
    "c2": "select c.query_id, n, list_append(alts, alt_no) as alts, list_append(terms, term) as terms from c1 c join slots s on s.query_id = c.query_id and slot = 1",
    "c3": "select c.query_id, n, list_append(alts, alt_no) as alts, list_append(terms, term) as terms from c2 c join slots s on s.query_id = c.query_id and slot = 2",
    "c4": "select c.query_id, n, list_append(alts, alt_no) as alts, list_append(terms, term) as terms from c3 c join slots s on s.query_id = c.query_id and slot = 3",
    "c5": "select c.query_id, n, list_append(alts, alt_no) as alts, list_append(terms, term) as terms from c4 c join slots s on s.query_id = c.query_id and slot = 4",
    "c6": "select c.query_id, n, list_append(alts, alt_no) as alts, list_append(terms, term) as terms from c5 c join slots s on s.query_id = c.query_id and slot = 5",
    "combo_lists": "select query_id, n, terms, cast(row_number() over (partition by query_id order by alts) - 1 as integer) as combo_id from (select * from c1 where n = 1 union all select * from c2 where n = 2 union all select * from c3 where n = 3 union all select * from c4 where n = 4 union all select * from c5 where n = 5 union all select * from c6 where n = 6)",
    "combos": "select query_id, combo_id, cast(n as integer) as slots, cast(unnest(range(len(terms))) as integer) as slot, unnest(terms) as term from combo_lists",
    "matched": "select query_id, combo_id, doc_id, slots from combos join postings using (term) group by query_id, combo_id, slots, doc_id having count(*) = slots",
    "found": "select m.query_id, m.combo_id, m.doc_id, m.slots, slot, pos from matched m join combos c using (query_id, combo_id) join positions p on p.doc_id = m.doc_id and p.term = c.term",
    # longer queries: the best way to each position of a slot, slot by slot
    "step_1": "select query_id, combo_id, doc_id, slots, pos as last, {'d': 0, 'o': 0, 'l': pos, 'p': [pos]} as way from found where slot = 0",
    **{
        f"step_{n}": f"select query_id, combo_id, doc_id, any_value(slots) as slots, last, min(way) as way from (select a.query_id, a.combo_id, a.doc_id, a.slots, b.pos as last, {{'d': way.d + abs(b.pos - a.last), 'o': way.o - cast(b.pos > a.last as integer), 'l': least(way.l, b.pos), 'p': list_append(way.p, b.pos)}} as way from step_{n - 1} a join found b using (query_id, combo_id, doc_id) where b.slot = {n - 1}) group by query_id, combo_id, doc_id, last"
        for n in range(2, 7)
    },
    "long_ways": " union all ".join(f"select query_id, combo_id, doc_id, way from step_{n} where slots = {n}" for n in range(1, 7)),
    "ways": """select query_id, combo_id, doc_id, {'d': 0, 'o': 0, 'l': pos, 'p': [pos]} as way from found where slots = 1
  union all select query_id, combo_id, a.doc_id, {'d': abs(b.pos - a.pos), 'o': -cast(b.pos > a.pos as integer), 'l': least(a.pos, b.pos), 'p': [a.pos, b.pos]} from found a join found b using (query_id, combo_id, doc_id) where a.slots = 2 and a.slot = 0 and b.slot = 1
  union all select query_id, combo_id, a.doc_id, {'d': abs(b.pos - a.pos) + abs(c.pos - b.pos), 'o': -cast(b.pos > a.pos as integer) - cast(c.pos > b.pos as integer), 'l': least(a.pos, b.pos, c.pos), 'p': [a.pos, b.pos, c.pos]} from found a join found b using (query_id, combo_id, doc_id) join found c using (query_id, combo_id, doc_id) where a.slots = 3 and a.slot = 0 and b.slot = 1 and c.slot = 2""",
    "near": "select query_id, combo_id, doc_id, cast(way.d as bigint) as distance, cast(-way.o as bigint) as ordered_pairs, way.p as positions from (select query_id, combo_id, doc_id, min(way) as way from ways group by query_id, combo_id, doc_id)",
    "best": "select * from (select *, row_number() over (partition by query_id, doc_id order by distance, ordered_pairs desc, combo_id) as nth from near) where nth = 1",
    "ranked": "select query_id, cast(row_number() over (partition by query_id order by distance, ordered_pairs desc, doc_id) as integer) as rank, doc_id, distance, ordered_pairs, array_to_string(positions, ',') as positions from best",
    "chosen": "select query_id, doc_id, unnest(positions) as pos from best",
}


#: Parts of the lemmatising index and of its queries, in the place of the plain ones.
RULES = {
    "terms": "select * from rule_terms",
    "words": "select query_id, show_lines, slot, coalesce(b.base, r.first) as word from rule_words r left join rule_bases b on b.word = r.word",
}


def sql(final: str, **more: str) -> str:
    """``final`` after the parts that it needs; ``more``: parts of the caller's own."""
    parts = PARTS | more
    done: dict[str, str] = {}

    def need(text: str) -> None:
        for name in re.findall(r"[a-z_0-9]+", re.sub(r"'[^']*'", "", text)):
            if name in parts and name not in done and parts[name] is not text:
                done[name] = ""
                need(parts[name])
                del done[name]
                done[name] = parts[name]

    need(final)
    return ("with " + ",\n".join(f"{k} as ({v})" for k, v in done.items()) + "\n" if done else "") + final
