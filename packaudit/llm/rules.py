"""Quality rules that vote or abstain, weighed by expectation maximisation. DataFrame functions only."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packaudit.llm.common import saved

#: White space between words.
SPACE = r"[\x20\x09-\x0D]+"
#: Frequent function words of the languages.
FUNCTION_WORDS = (
    "the of and to in is that it for was on are as with by be this at from not or have an which "
    "de la le les et des en un une du dans que qui pour est sur pas par au avec "
    "der die und das den von zu mit sich auf für ist im dem nicht ein eine als auch es "
    "el los las y del se con una su al lo como más pero sus le ya o este sí"
).split()
#: Rounds of estimation at most; it ends when neither the share of good texts nor a rate moves by more.
ROUNDS, SETTLED = 25, 1e-4
#: Where estimation starts: probability that a text is good if no rule votes against it, and if one does.
UNOPPOSED, OPPOSED = 0.98, 0.1
#: A rule that votes against so large a share of the texts doesn't suit the table: estimation doesn't start from it.
UNSUITED = 0.9
#: What an abstention adds to the log odds at most, either way: it can't decide alone.
ABSTENTION = 1.0
#: The first estimates count like so many texts, as a share of a class, in all later ones: they keep the meaning of the classes.
ANCHOR = 0.5
#: How a rule votes on all texts counts like so many texts, as a share of all, in its rates on either class.
PRIOR = 0.002


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once."""
    return F.transform(F.array(value), body)[0]


def _repeat_words(hashes: Column) -> Column:
    """Words covered by a 5-word window that is in the text twice or more, of the words' hashes."""

    def covered(windows: Column) -> Column:
        """Windows in the order (hash, place); a repeated one stands beside its like."""
        ranked = F.sort_array(F.transform(windows, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))

        def places(s: Column) -> Column:
            twins = F.filter(
                F.transform(
                    s,
                    lambda e, k: F.when(
                        ((k > 0) & (F.get(s, k - 1)["x"] == e["x"])) | ((k + 1 < F.size(s)) & (F.get(s, k + 1)["x"] == e["x"])),
                        e["i"],
                    ),
                ),
                lambda p: p.isNotNull(),
            )
            return _let(F.sort_array(twins), length)

        def length(p: Column) -> Column:
            steps = F.transform(p, lambda x, k: F.when(k + 1 < F.size(p), F.least(F.lit(5), F.get(p, k + 1) - x)).otherwise(5))
            return F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)

        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0).cast("long")).otherwise(_let(ranked, places))

    def windows(h: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(0), F.size(h) - 5),
            lambda i: F.xxhash64(F.get(h, i), F.get(h, i + 1), F.get(h, i + 2), F.get(h, i + 3), F.get(h, i + 4)),
        )

    return _let(hashes, lambda h: F.when(F.size(h) < 6, F.lit(0).cast("long")).otherwise(_let(windows(h), covered)))


def features(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs and a struct column `_f` with what the rules look at; a null text has no words."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))

    def of(t: Column, words: Column) -> Column:
        joined = F.array_join(words, "")
        lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.length(joined).cast("long").alias("word_chars"),
            (F.size(F.split(t, r"[#*$%&|<>]", -1)) - 1).cast("long").alias("n_symbols"),
            _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
            _repeat_words(F.transform(words, lambda w: F.xxhash64(w))).alias("n_repeat_words"),
            F.size(lines).cast("long").alias("n_lines"),
            (F.size(F.split(t, r"\p{Lu}", -1)) - 1).cast("long").alias("n_upper"),
            (F.size(F.split(t, r"[!?]{2}", -1)) - 1).cast("long").alias("n_shouts"),
            (F.size(F.split(t, r"[.!?\u3002]", -1)) - 1).cast("long").alias("n_stops"),
            (F.size(F.split(t, r"[0-9]", -1)) - 1).cast("long").alias("n_digits"),
            F.size(F.filter(words, lambda w: F.lower(w).isin(*dict.fromkeys(FUNCTION_WORDS)))).cast("long").alias("n_function_words"),
        )

    made = _let(text, lambda t: _let(F.array_remove(F.split(t, SPACE), ""), lambda words: of(t, words)))
    return docs.withColumn("_f", made)


def votes() -> dict[str, Column]:
    """Each rule's vote on `_f`: 1 for good text, -1 against, 0 where it can't tell."""
    f = lambda name: F.col(f"_f.{name}")
    words, chars, lines = F.greatest(f("n_words"), F.lit(1)), F.greatest(f("word_chars"), F.lit(1)), F.greatest(f("n_lines"), F.lit(1))

    def rule(good: Column, bad: Column) -> Column:
        return F.when(bad, -1).when(good, 1).otherwise(0)

    enough = f("n_words") >= 30
    return {
        "symbols": rule(f("n_symbols") * 50 <= words, f("n_symbols") * 10 > words),
        "lines": rule((lines >= 3) & (f("n_dup_lines") * 20 <= lines), f("n_dup_lines") * 10 > lines * 3),
        "word_length": rule((chars >= words * 3) & (chars <= words * 8), (chars < words * 2) | (chars > words * 12)),
        "capitals": rule(f("n_upper") * 10 <= chars, f("n_upper") * 4 > chars),
        "shouts": rule(enough & (f("n_shouts") * 200 <= words), f("n_shouts") * 10 > words),
        # few hits are no evidence: the language may be another one
        "function_words": rule(f("n_function_words") * 100 >= words * 15, F.lit(False)),
        "stops": rule((f("n_stops") * 3 <= words) & (f("n_stops") * 40 >= words), (f("n_stops") * 2 > words) | (f("n_stops") * 100 < words)),
        "line_words": rule(words >= lines * 5, (lines >= 5) & (words < lines * 3)),
        "digits": rule(f("n_digits") * 20 <= chars, enough & (f("n_digits") * 4 > chars)),
    }


class VoteModel:
    """Share of good texts, and of each rule how often it votes -1, 0 and 1 on good and on bad ones."""

    def __init__(self, share: float, good: dict[str, tuple[float, ...]], bad: dict[str, tuple[float, ...]]):
        self.share, self.good, self.bad = share, good, bad

    def weights(self) -> dict[str, tuple[float, ...]]:
        """What each vote of a rule (-1, 0, 1) adds to the log odds of good.

        A vote against never speaks for a text and a vote in favour never against it, whatever the
        estimate says; an abstention counts a little.
        """
        out = {}
        for n in self.good:
            against, none, favour = (math.log(g / b) for g, b in zip(self.good[n], self.bad[n], strict=True))
            out[n] = min(against, 0.0), max(-ABSTENTION, min(none, ABSTENTION)), max(favour, 0.0)
        return out

    def moved(self, other: "VoteModel") -> float:
        """The largest change between two estimates."""
        pairs = [(self.share, other.share)] + [p for mine, its in ((self.good, other.good), (self.bad, other.bad)) for n in mine for p in zip(mine[n], its.get(n, (0.0,) * 3), strict=True)]
        return max(abs(a - b) for a, b in pairs)

    def posterior(self) -> Column:
        """Probability that a text is good, given its votes (columns _v_<rule>)."""
        odds = F.lit(math.log(self.share / (1 - self.share)))
        for name, (against, none, favour) in self.weights().items():
            odds = odds + F.when(F.col(f"_v_{name}") < 0, against).when(F.col(f"_v_{name}") > 0, favour).otherwise(none)
        return 1 / (1 + F.exp(-odds))


def fit(voted: DataFrame, names: list[str], rounds: int = ROUNDS) -> VoteModel:
    """Expectation maximisation over the distinct vote patterns, 3^rules of them at most.

    Each round is one aggregation: the posterior of each pattern under the last estimates, then from
    its sums the share of good texts and how each rule votes on either class. The two classes get
    rates of their own, so a rule may be sure of one and blind for the other, and an abstention says
    what it is worth. Rates lean a little towards the rule's votes on all texts, which keeps them
    off 0. At first a text is doubtful if a rule votes against it, of those rules that don't vote
    against nearly all texts. If no text is doubtful then, or all are alike, nothing tells two
    classes apart, and all texts stay as good as they were.
    """
    columns = [f"_v_{n}" for n in names]
    patterns = saved(voted.groupBy(*columns).agg(F.count("*").alias("_n")).coalesce(1), "votes")
    opposed = patterns.agg(F.sum("_n").alias("n"), *[F.sum(F.when(F.col(c) < 0, F.col("_n")).otherwise(0)).alias(c) for c in columns]).first()
    suited = [c for c in columns if opposed["n"] and opposed[c] < UNSUITED * opposed["n"]]
    p = F.when(F.least(F.lit(0), F.lit(0), *[F.col(c) for c in suited]) < 0, OPPOSED).otherwise(UNOPPOSED)
    model, first = VoteModel(UNOPPOSED, {}, {}), None
    for _ in range(rounds):
        weight = {"g": F.col("_n") * F.col("_p"), "b": F.col("_n") * (1 - F.col("_p"))}
        row = (
            patterns.withColumn("_p", p)
            .agg(
                F.sum("_n").alias("n"),
                F.sum(weight["g"]).alias("good"),
                *[F.sum(F.when(F.col(c) == v, w).otherwise(0.0)).alias(f"{k}{v}{c}") for c in columns for v in (-1, 0, 1) for k, w in weight.items()],
            )
            .first()
        )
        if not row["n"]:
            break
        n, held = row["n"], PRIOR * row["n"] + 1
        size = {"g": row["good"], "b": n - row["good"]}
        every = {c: [(row[f"g{v}{c}"] + row[f"b{v}{c}"] + 1) / (n + 3) for v in (-1, 0, 1)] for c in columns}
        rates = {
            k: {name: tuple((row[f"{k}{v}{c}"] + held * x) / (size[k] + held) for v, x in zip((-1, 0, 1), every[c], strict=True)) for name, c in zip(names, columns, strict=True)}
            for k in "gb"
        }
        first = first or rates
        rates = {k: {x: tuple((r + ANCHOR * f) / (1 + ANCHOR) for r, f in zip(rates[k][x], first[k][x], strict=True)) for x in names} for k in "gb"}
        before, model = model, VoteModel((row["good"] + 1) / (n + 2), rates["g"], rates["b"])
        if model.moved(before) < SETTLED:
            break
        p = model.posterior()
    return model


BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_at: float = 0.5, with_rows: bool = False) -> DataFrame:
    """doc_id (or with_rows all columns) with n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, quality_probability, base_failed and kept.

    A text fails the base if it has under 10 words or over a fifth of its words lie in repeated
    5-word windows. The rules look at other things; their rates are estimated on the texts that
    pass the base, and of these the ones whose posterior probability reaches keep_at are kept. A
    null or empty text fails. Where the votes tell no two classes apart (all texts alike, a rule
    that votes against nearly all of them), all that pass the base are kept, in any language.
    Columns of docs with one of these names, or that begin with _v_ or _f, are
    replaced. Repeated rows and null ids stay as they are; an empty table gives none.
    """
    rules = votes()
    own = {*BASE, "quality_probability", "base_failed", "kept", "_f"}
    if with_rows:
        rest = [c for c in docs.columns if c not in own and not c.startswith("_v_")]
        made = features(docs.select(rest), text_col)
    else:
        rest = ["doc_id"]
        made = features(docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("_text")), "_text").drop("_text")
    voted = saved(made.withColumns({f"_v_{n}": v.cast("tinyint") for n, v in rules.items()}), "rules")
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    passed = voted.select(F.col("_f.n_words").alias("n_words"), F.col("_f.n_repeat_words").alias("n_repeat_words"), *[f"_v_{n}" for n in rules]).where(~failed)
    model = fit(passed, list(rules))
    return (
        voted.withColumn("quality_probability", F.round(model.posterior(), 6))
        .select(*rest, *[F.col(f"_f.{c}") for c in BASE], "quality_probability")
        .withColumn("base_failed", failed)
        .withColumn("kept", ~failed & (F.col("quality_probability") >= keep_at))
    )
