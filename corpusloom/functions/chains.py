"""Enumerated topic chains: recognising them in canon text and showing them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import ellipsis, let, or_none, squeeze, strip, text_or_blank

# Recognised passages and the chain each stands for.
CONFIDENCE_LEAD = "Experiential confidence in the"
SEED_CLAUSES = ["deeds are the field", "consciousness is the seed", "craving is the moisture"]
SEED_CHAIN = ["deeds", "consciousness", "craving", "regeneration into a new state of existence"]
TRAININGS_PATTERN = r"higher ethics,\s*the higher mind,\s*and\s*the higher wisdom"
TRAININGS_CHAIN = ["higher ethics", "higher mind", "higher wisdom"]
REFUGE_CLAUSES = ["gone for refuge to the Buddha", "refuge to the Buddha, the teaching"]
REFUGE_CHAIN = [
    "refuge to the Buddha, the teaching, and the Saṅgha",
    "ethical, of good character",
    "freely generous, open-handed, loving to let go",
    "praised by ascetics and brahmins; deities praise them",
]
PRECEPTS_CHAIN = [
    "precepts and observances, lifestyles, and spiritual paths",
    "skillful qualities grow / unskillful decline",
    "fruitful",
]
FOOL_CHAIN = [
    "hurtful deeds by way of body, speech, and mind",
    "kind deeds by way of body, speech, and mind",
    "train: shun fool-qualities; follow astute qualities",
]
FRAGRANCE_CHAIN = ["fragrance of roots", "heartwood", "flowers"]


def _one(values: list[str]) -> Column:
    return F.array(F.array(*[F.lit(v) for v in values]))


def extract_chains(c: Column | str) -> Column:
    """``struct<chains,method>`` of a canon text; the first recognised family wins."""
    return let(F.replace(text_or_blank(c), F.lit("<j>"), F.lit(" ")), _recognise)


def _recognise(t: Column) -> Column:
    low = F.lower(t)
    none = F.array().cast("array<array<string>>")

    heads = F.regexp_extract_all(t, F.lit(rf"(?U){CONFIDENCE_LEAD}\s+([^:]+):"), F.lit(1))

    def label(head: Column) -> Column:
        h = strip(head)
        name = (
            F.when(F.rlike(h, F.lit(r"(?i)\Abuddha")), F.lit("Buddha"))
            .when(F.rlike(h, F.lit(r"(?i)\Ateaching")), F.lit("teaching"))
            .when(h.contains("Saṅgha") | F.rlike(h, F.lit(r"(?i)\Asangha")), F.lit("Saṅgha"))
            .otherwise(F.get(F.split(squeeze(h), " "), F.lit(0)))
        )
        return F.concat(F.lit("experiential confidence in the "), name)

    labels = F.transform(heads, label)
    families = [
        (
            t.contains(CONFIDENCE_LEAD) & (F.size(labels) >= 3),
            F.array(F.slice(labels, 1, 3)),
            "experiential_confidence_three",
        ),
        (
            t.contains(SEED_CLAUSES[0]) & t.contains(SEED_CLAUSES[1]) & t.contains(SEED_CLAUSES[2]),
            _one(SEED_CHAIN),
            "field_seed_moisture",
        ),
        (F.rlike(t, F.lit(rf"(?iU){TRAININGS_PATTERN}")), _one(TRAININGS_CHAIN), "three_higher_trainings"),
        (t.contains(REFUGE_CLAUSES[0]) | t.contains(REFUGE_CLAUSES[1]), _one(REFUGE_CHAIN), "fragrance_virtue"),
        (t.contains("precepts and observances") & low.contains("fruitful"), _one(PRECEPTS_CHAIN), "precepts_fruitful"),
        (
            t.contains("A fool is known by three things") & t.contains("hurtful deeds"),
            _one(FOOL_CHAIN),
            "fool_astute_three",
        ),
        (
            low.contains("three kinds of fragrance") & t.contains("roots") & t.contains("heartwood"),
            _one(FRAGRANCE_CHAIN),
            "three_fragrances_wind",
        ),
    ]
    chains = F.when(strip(t) == "", none)
    method = F.when(strip(t) == "", F.lit("empty"))
    for test, value, name in families:
        chains = chains.when(test, value)
        method = method.when(test, F.lit(name))
    return F.struct(
        chains.otherwise(none).alias("chains"),
        method.otherwise(F.lit("unmatched_needs_review")).alias("method"),
    )


def column_title(category: Column, items: Column) -> Column:
    first = strip(F.get(items, F.lit(0)))
    return (
        F.when(text_or_blank(category) != "", strip(F.replace(category, F.lit("_"), F.lit(" "))))
        .when(F.coalesce(F.size(items) > 0, F.lit(False)), ellipsis(first, 80))
        .otherwise(F.lit("Chain"))
    )


def chain_display(items: Column, is_ordered: Column) -> Column:
    arrow = F.when(F.coalesce(is_ordered, F.lit(False)), F.lit("→")).otherwise(F.lit("↓"))
    shown = F.transform(items, text_or_blank)
    folded = F.aggregate(
        F.slice(shown, F.lit(2), F.greatest(F.size(shown) - 1, F.lit(0))),
        F.get(shown, F.lit(0)),
        lambda acc, x: F.concat(acc, F.lit(" "), arrow, F.lit(" "), x),
    )
    return F.when(F.coalesce(F.size(items) > 0, F.lit(False)), folded).otherwise(F.lit(""))


def chain_caption(category: Column, items: Column, count: Column, is_ordered: Column) -> Column:
    n = F.coalesce(count, F.size(items), F.lit(0))
    return F.concat(
        F.when(strip(category) != "", F.concat(F.lit("Category: "), strip(category), F.lit(" · "))).otherwise(
            F.lit("")
        ),
        F.when(F.coalesce(is_ordered, F.lit(False)), F.lit("Ordered")).otherwise(F.lit("Unordered")),
        F.when(n > 0, F.concat(F.lit(" · "), n.cast("string"), F.lit(" items"))).otherwise(F.lit("")),
    )


def chain_block(suttaid: Column, cid: Column, chain: Column) -> Column:
    """Text form of a chain, one numbered line per item."""
    none = F.array().cast("array<string>")
    cat = strip(chain["category"])
    items = F.coalesce(chain["items"], none)
    numbered = F.transform(
        items, lambda x, i: F.concat(F.lit("  "), (i + 1).cast("string"), F.lit(". "), strip(x))
    )
    head = F.array(
        F.concat(F.lit("SUTTAID: "), suttaid),
        F.concat(F.lit("COMMENTARY_ID: "), cid),
        F.lit(""),
        F.lit("CHAIN (enumerated links / topics for this discourse; not verbatim scripture):"),
        F.concat(F.lit("Category: "), F.coalesce(or_none(cat), F.lit("(none)"))),
        F.concat(
            F.lit("Ordered pair: "),
            F.when(F.coalesce(chain["is_ordered"], F.lit(False)), F.lit("yes")).otherwise(F.lit("no")),
        ),
        F.lit("Items:"),
    )
    return F.array_join(F.concat(head, numbered), "\n")


def chain_json(chain: Column) -> Column:
    """JSON of a chain with a space after separators, in the key order items, count, is_ordered, category."""

    def quoted(c: Column) -> Column:
        return F.to_json(F.array(c))

    parts = F.array(
        F.when(
            chain["items"].isNotNull(),
            F.concat(
                F.lit('"items": ['),
                F.array_join(
                    F.transform(chain["items"], lambda x: F.regexp_replace(quoted(x), r"\A\[|\]\z", "")), ", "
                ),
                F.lit("]"),
            ),
        ),
        F.when(chain["count"].isNotNull(), F.concat(F.lit('"count": '), chain["count"].cast("string"))),
        F.when(
            chain["is_ordered"].isNotNull(), F.concat(F.lit('"is_ordered": '), chain["is_ordered"].cast("string"))
        ),
        F.when(
            chain["category"].isNotNull(),
            F.concat(F.lit('"category": '), F.regexp_replace(quoted(chain["category"]), r"\A\[|\]\z", "")),
        ),
    )
    return F.when(chain.isNull(), F.lit("")).otherwise(
        F.concat(F.lit("{"), F.array_join(F.array_compact(parts), ", "), F.lit("}"))
    )
