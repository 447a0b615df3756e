"""Text functions as Column expressions; all stay in the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicon as L


def let(value: Column, body) -> Column:
    return F.transform(F.array(value), body)[0]


def strings(values) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def any_of(conditions) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def strip(x: Column) -> Column:
    return F.regexp_replace(x, "^\\s+|\\s+$", "")


def tokens(x: Column) -> Column:
    """Whitespace tokens, without empty ones."""
    return F.filter(F.split(x, "\\s+"), lambda t: t != "")


def normalize_answer(x: Column) -> Column:
    return F.lower(strip(x))


def normalize(x: Column) -> Column:
    """Clock formats, grey to gray, three typos, white space; in this order."""
    steps = [
        ("(\\d+)'o\\s+clock", "$1 o'clock"), ("(\\d+)o'clock", "$1 o'clock"), ("(\\d+)\\s+o\\s+clock", "$1 o'clock"), ("(\\d+)\\s*o'clock'", "$1 o'clock"),
        ("(?<!\\d)(0*(?:\\d|1[0-2]))\\s*o'clock", "$1 o'clock"),
        ("(?i)\\bgrey\\b", "gray"), ("(?i)\\bsorrounded\\b", "surrounded"), ("(?i)\\bdestinaton\\b", "destination"), ("(?i)\\bappartment\\b", "apartment"), ("\\s+", " "),
    ]
    return strip(reduce(lambda c, s: F.regexp_replace(c, *s), steps, x))


def clock_hour(x: Column) -> Column:
    """'1' to '12' or null: a number first, then words."""

    def pick(t: Column) -> Column:
        hour = F.regexp_extract(t, "(\\d+)\\s*o'?clock", 1).try_cast("int")
        found = F.when((hour >= 1) & (hour <= 12), hour.cast("string"))
        for i, word in enumerate(L.CLOCK_WORDS, 1):
            found = F.coalesce(found, F.when(t.rlike(f"\\b(?:{i}|{word})\\s+o'?clock"), str(i)))
        return found

    return let(F.lower(normalize(x)), pick)


def clock_hour_raw(x: Column) -> Column:
    """The validator's: no normalization, no range check, leading zeros kept."""
    t = F.lower(x)
    found = F.when(t.rlike("\\d+\\s*o'?clock"), F.regexp_extract(t, "(\\d+)\\s*o'?clock", 1))
    for i, word in enumerate(L.CLOCK_WORDS, 1):
        found = F.coalesce(found, F.when(t.rlike(f"\\b{word}\\s+o'?clock"), str(i)))
    return found


def contains_any(x: Column, phrases) -> Column:
    return any_of(x.contains(p) for p in phrases)


def yes_no(x: Column) -> Column:
    """True, false or null by substrings; yes is tried first, so 'not visible' is true and 'north' false."""
    t = F.lower(x)
    return F.when(contains_any(t, L.YES), True).when(contains_any(t, L.NO), False)


def canonical(feature: Column, groups: dict) -> Column:
    """The first group that holds the feature, else the feature."""
    first: dict[str, str] = {}
    for name, members in groups.items():
        for m in members:
            first.setdefault(m, name)
    if not first:
        return feature
    return F.coalesce(F.create_map(*[F.lit(x) for kv in first.items() for x in kv])[feature], feature)


def features(x: Column, category: str, lexicon: dict = L.EVAL, canonicalize: bool = True) -> Column:
    """Sorted distinct features of a category. Patterns are literals, so each is compiled once; names are looked up here."""
    terms, groups = lexicon[category]
    first: dict[str, str] = {}
    for name, members in groups.items() if canonicalize else ():
        for m in members:
            first.setdefault(m, name)
    t = F.lower(x)
    found = F.filter(F.array(*[F.when(t.contains(w) & t.rlike(f"\\b{w}\\b"), first.get(w, w)) for w in terms]), lambda w: w.isNotNull())
    if category == "directions":
        clock = "(?:\\d+\\s*|(?:" + "|".join(L.CLOCK_WORDS) + ")\\s+)o'?clock"
        found = F.concat(F.when(t.contains("clock"), F.regexp_extract_all(t, F.lit(clock), 0)).otherwise(F.array().cast("array<string>")), found)
    return F.array_sort(F.array_distinct(found))


def _groups(groups: dict) -> Column:
    return F.array(*[strings(g) for g in groups.values()])


def synonyms(groups: dict, terms: list[str]) -> Column:
    """Map of each grouped feature to the features of the lexicon that hold a member of one of its groups."""
    known = sorted({*terms, *groups, *(m for g in groups.values() for m in g)})
    near = {f: [p for p in known if any(f in g and any(x in p for x in g) for g in groups.values())] for f in sorted({m for g in groups.values() for m in g})}
    return F.create_map(*[c for f, ps in near.items() for c in (F.lit(f), strings(ps))])


def matched(gold: Column, other: Column, near: Column, exact: bool = True) -> Column:
    """Share of gold features that stand in other by a synonym or, if exact, themselves."""
    itself = lambda s, f: F.array_contains(s["o"], f) if exact else F.lit(False)
    return let(F.struct(gold.alias("g"), other.alias("o"), near.alias("n")), lambda s: F.size(F.filter(s["g"], lambda f: itself(s, f) | F.coalesce(F.arrays_overlap(s["n"][f], s["o"]), F.lit(False)))) / F.size(s["g"]))


def _recall(gold: Column, hit) -> Column:
    return F.size(F.filter(gold, hit)) / F.size(gold)


def direction_score(pred: Column, gold: Column) -> Column:
    """Of two feature arrays: equality of clock hours, or the share of gold directions with a synonym, whichever is more."""
    words = F.create_map(*[F.lit(x) for i, w in enumerate(L.CLOCK_WORDS, 1) for x in (w, i)])

    def hour(d: Column) -> Column:
        """Of a direction feature, which stands in normalized form."""
        number = F.coalesce(F.regexp_extract(d, "^(\\d+)\\s*o'?clock$", 1).try_cast("int"), F.when(d.endswith("clock"), words[F.split_part(d, F.lit(" "), F.lit(1))]))
        return F.when((number >= 1) & (number <= 12), number)

    hours = lambda a: F.array_sort(F.array_distinct(F.filter(F.transform(a, hour), lambda h: h.isNotNull())))
    clock = F.when((F.size(hours(gold)) > 0) & (hours(gold) == hours(pred)), 1.0).otherwise(0.0)
    none = lambda a: F.size(a) == 0
    return F.when(none(gold) & none(pred), 1.0).when(none(gold) | none(pred), 0.0).otherwise(F.greatest(clock, matched(gold, pred, synonyms(L.DIRECTION_GROUPS, L.DIRECTIONS))))


def yesno_score(pred: Column, gold: Column) -> Column:
    return F.when(yes_no(pred) == yes_no(gold), 1.0).otherwise(0.0)


def attribute_score(pred_colors: Column, gold_colors: Column, pred_shapes: Column, gold_shapes: Column) -> Column:
    part = lambda p, g: F.when(F.size(g) > 0, F.size(F.array_intersect(p, g)) / F.size(g))
    c, s = part(pred_colors, gold_colors), part(pred_shapes, gold_shapes)
    return F.coalesce((c + s) / 2, c, s, F.lit(0.0))


def landmark_score(pred: Column, gold: Column) -> Column:
    p, g = F.array_join(pred, " "), F.array_join(gold, " ")
    squeeze = lambda c: F.replace(c, F.lit(" "), F.lit(""))
    return F.when((F.size(gold) == 0) | (F.size(pred) == 0), 0.0).when(squeeze(p) == squeeze(g), 1.0).when(p.contains(g) | g.contains(p), 0.8).otherwise(matched(gold, pred, synonyms(L.LANDMARK_GROUPS, L.LANDMARKS), exact=False))


def movement_score(pred: Column, gold: Column) -> Column:
    """A gold verb counts if it or a member of the first group that holds it is there."""
    first = lambda g: F.filter(_groups(L.MOVEMENT_GROUPS), lambda s: F.array_contains(s, g))
    near = lambda g: F.array_contains(pred, g) | F.coalesce(F.arrays_overlap(F.get(first(g), F.lit(0)), pred), F.lit(False))
    return F.when((F.size(gold) == 0) | (F.size(pred) == 0), 0.0).otherwise(_recall(gold, near))


def banned(pred: Column, gold: Column) -> Column:
    return any_of(F.lower(pred).contains(b.lower()) & ~F.lower(gold).contains(b.lower()) for b in L.BANNED)


def task_type(question: Column) -> Column:
    return F.when(any_of(F.lower(question).rlike(p) for p in L.QUESTION_CUES), "attribute_complete").otherwise("precision_short")


def task_type_oracle(question: Column, gold: Column) -> Column:
    return F.when(contains_any(F.lower(question), L.ATTRIBUTE_CUES) | contains_any(F.lower(gold), [*L.COLORS, *L.SHAPES]), "attribute_complete").otherwise("precision_short")


def question_of(x: Column) -> Column:
    """Null if a marker is missing."""
    return F.when(x.contains("[INS]"), F.btrim(F.substr(x, F.lit(6), F.locate("[INS]", x) - 6)))


def answer_of(x: Column) -> Column:
    return F.when(x.contains("[INS]"), F.btrim(F.substr(x, F.locate("[INS]", x) + 5)))


def rule_positives(x: Column) -> Column:
    """Two simple paraphrases."""
    up, low = F.upper(x), F.lower(x)
    by_key = F.lit(None).cast("array<string>")
    for key, pair in reversed(L.POSITIVES.items()):
        by_key = F.when(up.contains(key), strings(pair)).otherwise(by_key)
    none = F.array().cast("array<string>")
    clock = F.when(up.contains("O'CLOCK") | up.contains("OCLOCK"), F.array(F.concat(F.lit("head towards "), low), F.concat(F.lit("move to "), low))).otherwise(none)
    return F.slice(F.concat(F.coalesce(by_key, none), clock, F.array_repeat(F.concat(F.lit("move "), low), 2)), 1, 2)


def rule_negative(x: Column) -> Column:
    up = F.upper(x)
    out = F.when(up.contains("O'CLOCK"), "go in the opposite direction").otherwise("go the other way")
    for key, other in reversed(L.OPPOSITES.items()):
        out = F.when(up.contains(key), f"go {other}").otherwise(out)
    return out


def parse_response(x: Column, n: int = 3) -> Column:
    """Clean lines of a generated response, at most n."""
    steps = ["\\(.*?\\)", "\\[.*?\\]", "(?i)Note:.*", "(?i)Additional context:.*", "^[0-9]+\\.?\\s*", "(?i)^(Positive|Negative)\\s*Paraphrases?:", "(?i)^(Positives?|Negatives?):"]
    clean = lambda s: F.regexp_replace(reduce(lambda c, p: strip(F.regexp_replace(c, p, "")), steps, strip(s)), "^[\"']|[\"']$", "")
    good = lambda s: (F.length(s) > 10) & ~F.lower(s).rlike("^(positive|negative)") & ~contains_any(F.lower(s), ["note:", "additional context", "explanation:"])
    return F.slice(F.filter(F.transform(F.split(F.coalesce(x, F.lit("")), "\n"), clean), good), 1, n)


def main_instruction(x: Column) -> Column:
    return reduce(lambda c, p: strip(F.regexp_replace(c, p, "")), ["\\(.*?\\)", "\\[.*?\\]", "(?i)Note:.*", "(?i)Additional context:.*"], x)


def simple_paraphrase(x: Column) -> Column:
    """The first substitution that fits, and no other."""
    out = x
    for a, b in reversed(L.SUBSTITUTIONS.items()):
        out = F.when(F.lower(x).contains(a), F.regexp_replace(x, "(?i)" + a, b)).otherwise(out)
    return out


def category(x: Column) -> Column:
    t = F.lower(x)
    return (
        F.when(t.rlike("\\d+\\s*o'?clock"), "clock_directions")
        .when(contains_any(t, ["north", "south", "east", "west"]), "cardinal_directions")
        .when(contains_any(t, ["next to", "in front of", "behind", "above", "below", "near", "across from"]), "spatial_relations")
        .when(t.rlike("(red|blue|green|white|gray|grey|black|brown)\\s+(building|structure|house|container)"), "landmark_descriptions")
        .when(x.contains(".") | t.contains("then") | t.contains("and"), "complex_instructions")
    )


def preview(x: Column, n: int) -> Column:
    return F.when(F.length(x) <= n, x).otherwise(F.concat(F.left(x, F.lit(n - 3)), F.lit("...")))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 where either is empty or zero."""
    return F.coalesce(F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))), F.lit(0.0))
