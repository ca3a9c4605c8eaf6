"""Operator 6, quality rules: line-first cleaning with built-in functions only, no shuffle.

Every line is judged by itself; a line fails when
* punctuation: it has more than ``symbol_rate`` symbols of ``[#*$%&|<>]`` a word, or more than half its
  words end in ``!!``, or it is at least three words and over half of those with two letters or more are in capitals;
* repetition: at least six words, and at least 40 % of them equal the word before;
* navigation: at most eight words and it has a phrase of site navigation in one of the four languages of the corpus (en, de, fr, es), or it is
  a menu: three separators (| > » · •) or more between items of at most three words on average, at most 40 words;
* boilerplate: it has a phrase of licences, cookie banners or scripts in one of those languages and is at most 25 words long.
Failing lines are removed; a document is rejected when it fails the base rules or loses more than
``most_lost`` of its word characters.

Null and empty texts have no words, so they fail the base rules (n_words < 50). Repeated rows give
repeated results; no rows give none. Other columns aren't read. Words are runs of anything but
``[\\x20\\x09-\\x0D]``; lines end at ``\\n`` only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterlake.llm.common import SPACE_CLASS, id_text

WORD = r"[^\x20\x09-\x0D]"
# Phrases that are fixed values; a phrase has no letter or digit before or behind it.
NAVIGATION = [
    "main menu", "skip to", "sign in", "log ?in", "sign up", "subscribe", "read more", "click here", "share this", "next page", "previous page", "back to top", "contact us", "site ?map", "home page",
    "hauptmen[uü]", "anmelden", "abmelden", "registrieren", "weiterlesen", "mehr lesen", "hier klicken", "n[aä]chste seite", "vorherige seite", "nach oben", "zum inhalt springen", "startseite", "kontakt",
    "menu principal", "se connecter", "connexion", "s[’']inscrire", "s[’']abonner", "lire la suite", "en savoir plus", "cliquez ici", "page suivante", "page pr[eé]c[eé]dente", "haut de page", "plan du site", "accueil", "contactez-nous",
    "men[uú] principal", "iniciar sesi[oó]n", "registrarse", "suscr[ií]bete", "leer m[aá]s", "haga clic aqu[ií]", "p[aá]gina siguiente", "p[aá]gina anterior", "volver arriba", "mapa del sitio", "inicio", "cont[aá]ctenos",
]
BOILERPLATE = [
    "all rights reserved", "released under the", "licensed under", "privacy policy", "terms of (?:use|service)", "uses? cookies", "enable javascript", r"copyright \(c\)",
    "alle rechte vorbehalten", "lizenziert unter", "datenschutzerkl[aä]rung", "nutzungsbedingungen", "verwendet cookies", "aktivieren sie javascript",
    "tous droits r[eé]serv[eé]s", "sous licence", "politique de confidentialit[eé]", "conditions d[’']utilisation", "utilise des cookies", "activez javascript",
    "todos los derechos reservados", "bajo la licencia", "pol[ií]tica de privacidad", "t[eé]rminos de uso", "utiliza cookies", "active javascript",
]
SEPARATOR = r"[|>»·•]"


def phrases(words: list[str], flags: str = "(?iu)") -> str:
    """A pattern for any of ``words``; ``flags`` are those by which the engine folds case beyond ASCII."""
    return rf"{flags}(?:^|[^\p{{L}}\p{{N}}])(?:{'|'.join(words)})(?:$|[^\p{{L}}\p{{N}}])"


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, SPACE_CLASS), lambda w: w != "")


def lines_of(text: Column) -> Column:
    """(line, its words) of every line that has a word."""
    return F.filter(F.transform(F.split(text, "\n"), lambda x: F.struct(x.alias("line"), words_of(x).alias("w"))), lambda x: F.size(x["w"]) > 0)


def judged(docs: DataFrame, symbol_rate: float = 0.25, most_lost: float = 0.5, id_col: str = "doc_id", text_col: str = "text", keep_id: bool = False) -> DataFrame:
    """Per document: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, n_lines, n_lost_lines, lost_chars.

    Each ``select`` names what later ones use more than once, so that Spark computes it once.
    """
    texts = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")) if keep_id else id_text(docs, id_col, text_col)
    split = texts.select("doc_id", "text", lines_of(F.col("text")).alias("lines")).select("*", F.flatten(F.col("lines.w")).alias("words"))
    hashed = split.select(
        "*",
        F.size("words").alias("n"),
        F.when(F.size("words") < 3, F.array().cast("array<bigint>")).otherwise(F.transform(F.sequence(F.lit(1), F.size("words") - 2), lambda i: F.xxhash64(F.element_at("words", i), F.element_at("words", i + 1), F.element_at("words", i + 2)))).alias("grams"),
        F.filter("lines", lambda x: _fails(x["line"], x["w"], symbol_rate)).alias("lost"),
    )
    # Windows are only sorted, with their places, where a text has two equal ones.
    ordered = hashed.select("*", F.when(F.size(F.array_distinct("grams")) < F.size("grams"), F.sort_array(F.transform("grams", lambda g, i: F.struct(g.alias("g"), i.alias("i"))))).otherwise(F.array().cast("array<struct<g:bigint,i:int>>")).alias("s"))
    twice = ordered.select("*", F.size("s").alias("m")).select(
        "*",
        F.when(F.col("m") == 0, F.array().cast("array<int>")).otherwise(
            F.sort_array(F.transform(F.filter("s", lambda x, k: ((k > 0) & (F.get("s", k - 1)["g"] == x["g"])) | ((k < F.col("m") - 1) & (F.get("s", k + 1)["g"] == x["g"]))), lambda x: x["i"]))
        ).alias("places"),
    )
    covered = F.when(F.size("places") == 0, F.lit(0)).otherwise(F.aggregate(F.sequence(F.lit(0), F.size("places") - 1), F.lit(0), lambda acc, k: acc + F.least(F.lit(3), F.coalesce(F.get("places", k + 1) - F.get("places", k), F.lit(3)))))
    # inline() of one struct: a filter on the verdict isn't pushed below it, which would compute everything again for each use.
    measured = twice.select(F.inline(F.array(F.struct(
        "doc_id",
        F.col("n").cast("long").alias("n_words"),
        F.char_length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct(F.col("lines.line")))).cast("long").alias("n_dup_lines"),
        covered.cast("long").alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        F.size("lost").cast("long").alias("n_lost_lines"),
        F.char_length(F.array_join(F.flatten(F.col("lost.w")), "")).cast("long").alias("lost_chars"),
    ))))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return measured.withColumn("base_failed", failed).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & (F.col("lost_chars") <= most_lost * F.col("word_chars"))).alias("kept"), "n_lines", "n_lost_lines", "lost_chars")


def _fails(line: Column, w: Column, symbol_rate: float) -> Column:
    """Whether a line of words ``w`` fails; a plain search goes before each count, so that clean lines cost little."""
    n = F.size(w)
    symbols = F.char_length(line) - F.char_length(F.translate(line, "#*$%&|<>", ""))
    shouted = F.size(F.filter(w, lambda x: F.endswith(x, F.lit("!!"))))
    capitals = F.size(F.filter(w, lambda x: x.rlike(r"\p{Lu}[\s\S]*\p{Lu}") & ~x.rlike(r"\p{Ll}")))
    lettered = F.size(F.filter(w, lambda x: x.rlike(r"\p{L}[\s\S]*\p{L}")))
    separators = F.char_length(line) - F.char_length(F.translate(line, "|>»·•", ""))
    again = F.size(F.filter(w, lambda x, i: (i > 0) & (F.get(w, i - 1) == x)))
    return (
        (line.rlike(r"[#*$%&|<>]") & (symbols > symbol_rate * n))
        | (F.contains(line, F.lit("!!")) & (2 * shouted > n))
        | ((n >= 3) & line.rlike(r"\p{Lu}\p{Lu}") & (2 * capitals > lettered))
        | ((n >= 6) & (again >= 0.4 * n))
        | ((n <= 8) & line.rlike(phrases(NAVIGATION)))
        | ((n <= 40) & line.rlike(SEPARATOR) & (separators >= 3) & (n <= 4 * separators + 3))
        | ((n <= 25) & line.rlike(phrases(BOILERPLATE) + "|©"))
    )


def kept_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **rules: float) -> DataFrame:
    """The rows of ``docs`` that are kept, all columns, without their failing lines; what lies between other lines stays.

    The verdict is computed in the row, on a copy of the columns under names of its own, so nothing is joined or shuffled.
    """
    symbol_rate = rules.get("symbol_rate", 0.25)
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    verdict = judged(row.select(F.col("row").alias("doc_id"), F.col(f"row.`{text_col}`").alias("text")), keep_id=True, **rules).where("kept")
    lines = F.filter(F.split(F.col(f"doc_id.`{text_col}`"), "\n"), lambda x: ~(x.rlike(WORD) & _fails(x, words_of(x), symbol_rate)))
    text = F.when(F.col("n_lost_lines") == 0, F.col(f"doc_id.`{text_col}`")).otherwise(F.array_join(lines, "\n"))
    return verdict.select(*[(text if c == text_col else F.col(f"doc_id.`{c}`")).alias(c) for c in docs.columns])



def oracle(symbol_rate: float = 0.25, most_lost: float = 0.5) -> str:
    """The same result in SQL, lines as rows."""
    navigation, boilerplate = (phrases(p, "(?i)").replace("'", "''") for p in (NAVIGATION, BOILERPLATE))
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
s AS (SELECT doc_id, x.line, [x FOR x IN string_split_regex(x.line, '[\x20\x09-\x0D]+') IF x <> ''] AS w FROM d, unnest(string_split(t, chr(10))) AS x(line)),
m AS (SELECT *, len(w) AS n, length(regexp_replace(line, '[^#*$%&|<>]', '', 'g')) AS symbols, length(regexp_replace(line, '[^|>»·•]', '', 'g')) AS separators,
  len([x FOR x IN w IF ends_with(x, '!!')]) AS shouted, len([x FOR x IN w IF regexp_matches(x, '\p{{Lu}}[\s\S]*\p{{Lu}}') AND NOT regexp_matches(x, '\p{{Ll}}')]) AS capitals,
  len([x FOR x IN w IF regexp_matches(x, '\p{{L}}[\s\S]*\p{{L}}')]) AS lettered, len([i FOR i IN range(2, len(w) + 1) IF w[i] = w[i - 1]]) AS again, coalesce(list_sum([length(x) FOR x IN w]), 0) AS chars
  FROM s WHERE len(w) > 0),
f AS (SELECT doc_id, line, chars, symbols > {symbol_rate} * n OR (shouted > 0 AND 2 * shouted > n) OR (n >= 3 AND 2 * capitals > lettered) OR (n >= 6 AND again >= 0.4 * n)
  OR (n <= 8 AND regexp_matches(line, '{navigation}')) OR (n <= 40 AND separators >= 3 AND n <= 4 * separators + 3) OR (n <= 25 AND regexp_matches(line, '{boilerplate}|©')) AS lost FROM m),
l AS (SELECT doc_id, count(*) AS n_lines, count(DISTINCT line) AS k, count(*) FILTER (WHERE lost) AS n_lost_lines, coalesce(sum(chars) FILTER (WHERE lost), 0) AS lost_chars FROM f GROUP BY doc_id),
v AS (SELECT doc_id, t, [x FOR x IN string_split_regex(t, '[\x20\x09-\x0D]+') IF x <> ''] AS w FROM d),
g AS (SELECT doc_id, i, w[i] || ' ' || w[i+1] || ' ' || w[i+2] AS g FROM v, unnest(range(1, len(w) - 1)) AS u(i)),
c AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g),
r AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM c, unnest([0, 1, 2]) AS u(k) WHERE n > 1 GROUP BY doc_id),
b AS (SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum([length(x) FOR x IN w]), 0)::BIGINT AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
  coalesce(n_lines - k, 0)::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words, len(w) < 50 OR 100 * coalesce(r.n, 0) > 50 * len(w) AS base_failed,
  coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_lost_lines, 0)::BIGINT AS n_lost_lines, coalesce(lost_chars, 0)::BIGINT AS lost_chars
  FROM v LEFT JOIN r USING (doc_id) LEFT JOIN l USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND lost_chars <= {most_lost} * word_chars AS kept, n_lines, n_lost_lines, lost_chars FROM b
"""
