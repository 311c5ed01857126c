"""The analysis chain as column expressions: lines, normalised text, tokens, terms. No Python runs on rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions import lexicon as L

NEWLINE = "\r\n|\n|\r"
# Fixed value: the tokenizer's alternatives, the first that fits wins. Everything else is dropped.
TOKEN = r"\d+(?:\.\d+)|\d+(?:,\d{3})*|'(?:s|ve|ll|m|re|d|t)\b|[.?!']|(?:[a-z]\.)+|[\w\d]+"
# Fixed value: a decimal that stands alone; addresses such as 192.168.1.1 and $3.50 stay.
DECIMAL = r"(?<!\S)\d+\.\d+\b(?!\.\d)"


def lines(text: Column) -> Column:
    return F.split(text, NEWLINE, -1)


def lowered(line: Column) -> Column:
    return F.lower(F.regexp_replace(line, r"^\s+|\s+$", ""))


def expanded(line: Column) -> Column:
    """n't as a word of its own."""
    out = F.regexp_replace(line, r"\b(" + "|".join(L.NEGATED) + r")n't\b", " $1 not ")
    for stem, word in L.NEGATED_IRREGULAR:
        out = F.regexp_replace(out, rf"\b{stem}n't\b", f" {word} not ")
    return out


def without_decimals(line: Column) -> Column:
    return F.regexp_replace(line, DECIMAL, "")


def normalised(line: Column) -> Column:
    return without_decimals(expanded(lowered(line)))


def tokens(line: Column) -> Column:
    """Tokens of a normalised line, by Unicode classes."""
    return F.regexp_extract_all(line, F.lit("(?U)" + TOKEN), F.lit(0))


def term(token: Column, before: Column) -> Column:
    """The indexed term of a token after ``before`` (null at a line's start); null if it is not indexed."""
    tails = [f"'{t}" for t in L.TAILS if t != "s"]
    out = (
        F.when(token.isin(*L.MARKS), None)
        .when(token == "'s", F.when(before.isin(*L.PRONOUNS), "s"))
        .when(token.isin(*tails), F.substring(token, 2, 9))
        .when(token.rlike(r"^\d+\.\d+$"), None)
        .when(token.contains("."), F.replace(token, F.lit("."), F.lit("")))
        .when(token.rlike(r"^[\d,]+$"), F.replace(token, F.lit(","), F.lit("")))
        .otherwise(token)
    )
    return F.when(out != "", out)


def line_terms(line: Column) -> Column:
    """The terms of a raw line, in order."""
    t = tokens(normalised(line))
    return F.filter(F.transform(t, lambda x, i: term(x, F.when(i > 0, F.get(t, i - 1)))), lambda x: x.isNotNull())


def line_tagged(line: Column) -> Column:
    """(term, tag) of a raw line's indexed tokens, in order."""
    t = tokens(normalised(line))
    before = lambda i: F.when(i > 0, F.get(t, i - 1))
    return F.filter(F.transform(t, lambda x, i: F.struct(term(x, before(i)).alias("term"), tag(x, before(i)).alias("tag"))), lambda x: x["term"].isNotNull())


def bucket(term: Column) -> Column:
    """The partition of a term: its first character, or one bucket for all other beginnings."""
    return F.when(term.rlike("^[0-9a-z]"), F.substring(term, 1, 1)).otherwise("_other")


def is_stop(term: Column) -> Column:
    return term.isin(*L.STOPWORDS)


def irregular(term: Column) -> Column:
    """The base of an irregular form, else null."""
    table = F.create_map(*(F.lit(x) for pair in (L.IRREGULAR_VERBS | L.IRREGULAR_PLURALS).items() for x in pair))
    return table[term]


def without_s(word: Column) -> Column:
    """The word without its final s; null if it has none to lose."""
    out = F.lit(None).cast("string")
    for pattern, base in reversed(L.S_RULES):
        out = F.when(word.rlike(pattern), F.regexp_replace(word, pattern, base.replace("\\", "$")) if base else F.lit(None)).otherwise(out)
    return out


def lemma(term: Column) -> Column:
    """The rule lemma: stopwords and numbers stay, irregular forms by list, then the final s."""
    return F.when(is_stop(term) | term.rlike("^[0-9]"), term).otherwise(F.coalesce(irregular(term), without_s(term), term))


# Fixed value: endings of adjectives.
ADJECTIVE = "^.{3,}(ous|ful|ive|less|able|ible)$"


def tag(token: Column, before: Column) -> Column:
    """A part-of-speech tag by form alone: numbers, marks, possessives, listed verbs, -ing, -ed, -iest, adjective endings, plurals; the rest is a noun."""
    verbs, plurals = ([w for w in table if w not in L.STOPWORDS] for table in (L.IRREGULAR_VERBS, L.IRREGULAR_PLURALS))
    return (
        F.when(token.isin(*L.MARKS), ".")
        .when(token.rlike(r"^\d[\d.,]*$"), "CD")
        .when(token == "'s", F.when(before.isin(*L.PRONOUNS), "VBZ").otherwise("POS"))
        .when(token.isin(*verbs), "VBD")
        .when(token.isin(*plurals), "NNS")
        .when(token.rlike("^.{3,}ing$"), "VBG")
        .when(token.rlike("^.{3,}ed$"), "VBD")
        .when(token.rlike("^.{3,}iest$"), "JJS")
        .when(token.rlike(ADJECTIVE), "JJ")
        .when(without_s(token).isNotNull(), "NNS")
        .otherwise("NN")
    )


def lemma_by_tag(term: Column, tag: Column) -> Column:
    """The lemma of a term for its tag, as far as lists and endings give it; ``bases_by_tag`` has what a vocabulary must attest.

    Nouns: by list, then the plural's ending, then (tagged as plural) any final s. Verbs, nouns in -ing and adjectives: verbs by list.
    """
    kind = F.create_map(*(F.lit(x) for pair in L.TAG_CLASSES.items() for x in pair))[tag]
    listed = lambda forms: F.create_map(*(F.lit(x) for pair in forms.items() for x in pair))[term]
    chopped = F.when(tag.isin("NNS", "NNPS") & term.endswith("s") & (F.length(term) > 1), F.substring(term, F.lit(1), F.length(term) - 1))
    verb = F.coalesce(listed(L.IRREGULAR_VERBS), term)
    as_verb = (kind == "v") | (tag == "JJ") | ((tag == "NN") & term.endswith("ing"))
    noun = F.coalesce(listed(L.IRREGULAR_PLURALS), without_s(term), chopped, term)
    return F.when(is_stop(term) | term.rlike("^[0-9]"), term).when(as_verb, verb).when(kind == "n", noun).otherwise(term)


def bases_by_tag(term: Column, tag: Column) -> Column:
    """Bases that count if the vocabulary has them: of verbs, nouns in -ing, adjectives; of comparatives."""
    kind = F.create_map(*(F.lit(x) for pair in L.TAG_CLASSES.items() for x in pair))[tag]
    as_verb = (kind == "v") | (tag == "JJ") | ((tag == "NN") & term.endswith("ing"))
    none = F.array().cast("array<string>")
    return F.when(is_stop(term), none).when(as_verb, verb_bases(term)).when(kind.isin("a", "r"), verb_bases(term, True)).otherwise(none)


def trims(word: Column) -> Column:
    """All results of the suffix trims that fit."""
    each = [F.when(word.endswith(a), F.concat(word.substr(F.lit(1), F.length(word) - len(a)), F.lit(b))) for a, b in L.TRIMS]
    return F.when(F.length(word) >= 4, F.array_distinct(F.array_compact(F.array(*each)))).otherwise(F.array().cast("array<string>"))


def verb_bases(word: Column, comparatives: bool = False) -> Column:
    """Bases of an -ed or -ing word (``comparatives``: also of -er and -est), in the order of trial."""
    rules = L.VERB_BASES + (L.COMPARATIVE_BASES if comparatives else ())
    return F.array_compact(F.array(*(F.when(word.rlike(fits) & word.rlike(p), F.regexp_replace(word, p, b.replace("\\", "$"))) for fits, p, b in rules)))


def query_words(raw: Column) -> Column:
    """A query line's words, lower-cased and split at white space."""
    return F.filter(F.split(F.lower(F.regexp_replace(raw, r"^\s+|\s+$", "")), r"\s+"), lambda w: w != "")


def query_term(word: Column, analyzer: str = "exact") -> Column:
    """A query word's term. ``rules``: as noun, then as verb by list, whichever changes it first; ``query_bases`` has what the vocabulary must attest."""
    plain = F.when(word.rlike("^[0-9]"), F.replace(word, F.lit(","), F.lit(""))).otherwise(word)
    if analyzer != "rules":
        return plain
    listed = lambda forms: F.create_map(*(F.lit(x) for pair in forms.items() for x in pair))[plain]
    return F.when(is_stop(plain) | plain.rlike("^[0-9]"), plain).otherwise(F.coalesce(listed(L.IRREGULAR_PLURALS), without_s(plain), listed(L.IRREGULAR_VERBS), plain))


def query_bases(word: Column) -> Column:
    """Bases of a query word as verb, adjective and adverb, in that order, which count if the vocabulary has them."""
    return F.when(is_stop(word) | word.rlike("^[0-9]"), F.array().cast("array<string>")).otherwise(verb_bases(word, True))
