"""License scans by sentence rules, in DataFrame expressions only.

A text is cut into sentences: at ``.``, ``!`` or ``?`` (a closing quote or bracket may follow) before white space, and at lines without a letter or
digit; a single line end ends nothing, since licence texts are wrapped. A sentence is normalised (A-Z to lower case, every run of
other characters than a-z and 0-9 to one space, so that comment marks at line starts go) and mapped to the identifiers of the known licence sentences that stand
in it, word for word, whatever leads in or follows; each counts once a sentence, at its first place, and one that is part of a longer one
found there doesn't. The identifiers of a text, in order, form a sequence, and a licence is reported if the
identifiers of one of its rules occur in the sequence in the rule's order (others may stand between) and none
that rules it out occurs. Each rule takes one pass over the sequence, whatever repeats in it.

Edge cases: a null or empty text has no sentence and no licence; a sentence that comes again counts again; rows and ids are returned
as they are, one result row for each input row; other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plexmat.llm.licensetexts import RULES, SENTENCES

SENTENCE_END = r"[.!?][\"')\]]{0,2}[ \t\r\n]|\n[^A-Za-z0-9\n]*\n"
#: Every known sentence holds one of these, so that all other texts need no cutting.
TELLTALE = r"(?i)licen[sc]|permi|redistribut|warrant|public domain|advertis|endorse|promote|copyright|cc0|software|distribut|reproduction"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normal(sentence: str) -> str:
    """The same normalisation in Python, for the fixed sentences."""
    kept = [c if c.isascii() and c.isalnum() else " " for c in sentence.translate(str.maketrans(_UPPER, _LOWER))]
    return " ".join("".join(kept).split())


def sentence_ids(text: Column, sentences: dict[str, str] = SENTENCES) -> Column:
    """The ordered identifiers of the known sentences in a text."""
    known = F.array(*(F.struct(F.lit(f" {normal(v)} ").alias("text"), F.lit(k).alias("id")) for k, v in sentences.items()))

    def plain(s: Column) -> Column:
        words = F.concat(F.lit(" "), F.regexp_replace(F.translate(s, _UPPER, _LOWER), "[^a-z0-9]+", " "), F.lit(" "))
        return F.regexp_replace(words, " +", " ")

    def in_text_order(found: Column, words: Column) -> Column:
        whole = F.filter(found, lambda k: ~F.exists(found, lambda o: (o["id"] != k["id"]) & F.contains(o["text"], k["text"])))
        return F.transform(F.array_sort(F.transform(whole, lambda k: F.struct(F.position(k["text"], words).alias("at"), k["id"].alias("id")))), lambda x: x["id"])

    def of_sentence(words: Column) -> Column:
        # a list of one binds what was found to a variable, which is worked out once
        found = F.filter(known, lambda k: F.contains(words, k["text"]))
        return F.flatten(F.transform(F.array(found), lambda f: in_text_order(f, words)))

    told = F.filter(F.split(text, SENTENCE_END), lambda s: s.rlike(TELLTALE))
    return F.when(text.rlike(TELLTALE), F.flatten(F.transform(F.transform(told, plain), of_sentence))).otherwise(F.array().cast("array<string>"))


def in_order(ids: list[str]) -> Column:
    """These identifiers occur in ``ids`` in this order, others between them: one pass, which steps on when the next one comes."""
    wanted = F.array(*map(F.lit, ids))
    if len(ids) == 1:
        return F.array_contains("ids", ids[0])
    return F.aggregate("ids", F.lit(0), lambda at, x: at + F.coalesce(x == F.get(wanted, at), F.lit(False)).cast("int")) == len(ids)


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  sentences: dict[str, str] = SENTENCES, rules: list[tuple[str, list[str], list[str]]] = RULES) -> DataFrame:
    """(doc_id, n_known, sentence_ids, licenses) of every row: ids in text order and sorted licences, joined by spaces."""
    def applies(ids: list[str], unless: list[str]) -> Column:
        return in_order(ids) & ~F.arrays_overlap("ids", F.array(*map(F.lit, unless))) if unless else in_order(ids)

    found = F.array(*(F.when(applies(ids, unless), F.lit(name)) for name, ids, unless in rules))
    names = F.when(F.size("ids") > 0, F.array_join(F.array_sort(F.array_distinct(F.filter(found, lambda x: x.isNotNull()))), " ")).otherwise("")
    return (
        docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
        .select("doc_id", sentence_ids(F.col("text"), sentences).alias("ids"))
        .select("doc_id", F.size("ids").cast("long").alias("n_known"), F.array_join("ids", " ").alias("sentence_ids"), names.alias("licenses"))
    )


def oracle() -> str:
    """The same scan as joins in DuckDB SQL: sentences as rows, a join with the known ones, and a glob for each rule."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    known = ", ".join(f"({quote(k)}, {quote(' ' + normal(v) + ' ')})" for k, v in SENTENCES.items())
    rules = ", ".join(f"({quote(name)}, {quote('* ' + ' * '.join(ids) + ' *')}, {'[' + ', '.join(quote(x) for x in unless) + ']'}::VARCHAR[])" for name, ids, unless in RULES)
    return f"""
WITH known(id, phrase) AS (VALUES {known}),
rules(licence, shape, unless) AS (VALUES {rules}),
docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
lists AS (SELECT r, string_split_regex(text, '[.!?]["'')\\]]{{0,2}}[ \\t\\r\\n]|\\n[^A-Za-z0-9\\n]*\\n') AS l FROM docs),
sentences AS (SELECT r, unnest(l) AS s, generate_subscripts(l, 1) AS i FROM lists),
plain AS (SELECT r, i, ' ' || trim(regexp_replace(regexp_replace(s, '[^A-Za-z0-9]+', ' ', 'g'), '  +', ' ', 'g')) || ' ' AS s FROM sentences),
low AS (SELECT r, i, translate(s, '{_UPPER}', '{_LOWER}') AS s FROM plain),
hits AS (SELECT r, i, id, phrase, strpos(s, phrase) AS place FROM low JOIN known ON contains(s, phrase)),
whole AS (SELECT * FROM hits h WHERE NOT EXISTS (SELECT 1 FROM hits o WHERE o.r = h.r AND o.i = h.i AND o.id <> h.id AND contains(o.phrase, h.phrase))),
seqs AS (SELECT r, count(*) AS n, string_agg(id, ' ' ORDER BY i, place, id) AS ids, list(id) AS seen FROM whole GROUP BY r),
found AS (SELECT DISTINCT r, licence FROM seqs, rules WHERE '  ' || replace(ids, ' ', '  ') || '  ' GLOB shape AND NOT list_has_any(seen, unless)),
names AS (SELECT r, string_agg(licence, ' ' ORDER BY licence) AS licenses FROM found GROUP BY r)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_known, coalesce(ids, '') AS sentence_ids, coalesce(licenses, '') AS licenses
FROM docs LEFT JOIN seqs USING (r) LEFT JOIN names USING (r)"""
