"""Stories: facts selected into scenes, prose bound to single facts, and its audit.

A ledger has at most some hundred facts, so selection and wording run on the driver. audit_texts() is the
same audit for any number of texts, as DataFrame joins.
"""

from __future__ import annotations

import datetime as dt
import json
import re
import secrets
import string
from collections import Counter
from collections.abc import Callable
from dataclasses import asdict

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import display as show
from ..functions import prose
from ..functions.numbers import finite
from ..session import small_side
from ..sources.delimited import InputError, Table
from .ledger import Fact, facts_of

#: Scenes of a story, scenes of one kind and of one column, and the least importance (fixed values).
LEAST_SCENES, MOST_SCENES, PER_KIND, PER_COLUMN, LEAST_IMPORTANCE = 3, 7, 2, 3, 20
#: The order of kinds in a story (fixed values).
ARC = (
    "overview", "trend", "category_leader", "concentration", "correlation", "seasonal", "volatility", "streak",
    "changepoint", "outlier", "extreme",
)
#: What a claim about a kind of fact computes, and its unit (fixed values).
OPERATIONS = {
    "overview": ("row_count", "count"),
    "trend": ("ols_trend", "percent-change"),
    "changepoint": ("mean_shift", "percent-change"),
    "outlier": ("mad_outlier", "absolute-value"),
    "volatility": ("coefficient_of_variation", "ratio"),
    "correlation": ("pearson_correlation", "pearson-r"),
    "category_leader": ("group_sum_leader", "sum"),
    "concentration": ("top_n_share", "percent-share"),
    "extreme": ("min_max", "absolute-value"),
    "streak": ("monotonic_run", "percent-change"),
    "seasonal": ("seasonal_mean", "percent-vs-mean"),
}
CLAIM_FIELDS = ("factId", "operation", "metric", "secondaryMetric", "unit", "direction", "period", "category")
THEMES, TONES = ("midnight", "paper", "aurora"), ("documentary", "upbeat", "executive")
#: Numbers that any text may have (fixed values).
FREE_NUMBERS = frozenset(float(x) for x in (*range(4), *range(1990, 2036)))
#: A change from which on a fact has a direction, in per cent (fixed value).
DIRECTED = 3.0
NAME_LENGTH, QUESTION_LENGTH, TITLE_LENGTH = 60, 300, 90

#: Says something about each of some facts: texts by the facts' ids, or a draft in JSON (see draft_of()).
Narrator = Callable[[list[Fact]], dict[str, str] | str]

_OPENERS = {
    "documentary": ("First,", "Next,", "Then,", "Meanwhile,", "Also,", "Further on,", "Finally,"),
    "upbeat": ("Look at this:", "And then:", "There is more:", "Better still, read on:", "Also on stage:", "Keep going:", "To top it off:"),
    "executive": ("Finding:", "Further:", "In addition:", "Related:", "Also relevant:", "Note:", "Last:"),
}
#: What follows a fact's own statement, by its kind and the tone. None has a number, a direction or a metric.
_KICKERS = {
    "trend": ("The line through the points hardly leaves room for doubt.", "That is a habit, not a fluke.", "Plan on the course, not on the last value."),
    "changepoint": ("Before and after are two different levels.", "A new chapter starts right there.", "Look for the decision or event at this date."),
    "outlier": ("One point stands apart from all others.", "This one refuses to blend in.", "Check this point before it enters an average."),
    "correlation": ("That they move so says nothing about which one causes it.", "Coincidence or cause? Worth asking.", "Test for a cause before acting on it."),
    "category_leader": ("Taken together, an average would hide this.", "Every table has its star.", "Such weight is a strength and a dependency."),
    "concentration": ("Few carry most of it.", "A short list does the heavy lifting.", "Spread, or the lack of it, is the risk here."),
    "seasonal": ("The calendar leaves its mark.", "It has a rhythm of its own.", "Compare like periods with like."),
    "volatility": ("The range says more than the mean.", "Never a dull moment.", "Budget for the range."),
    "streak": ("A run of one direction, without a break.", "Now that is a run.", "Ask what ends it."),
    "extreme": ("These are the bounds of what was seen.", "For the record books.", "Use these as points of reference."),
}
_UNEVEN = ("The path was uneven.", "A bumpy road, but one direction.", "Read the slope, not the noise.")
_CLOSINGS = ("What the data say", "That is the story", "Summary")


def select_scenes(facts: list[Fact]) -> list[Fact]:
    """The facts of a story's scenes, from a ranked ledger. A fact that one cap drops doesn't count for the other."""
    pool = [f for f in facts if f.kind != "overview" and f.importance >= LEAST_IMPORTANCE]
    kinds, columns, taken = Counter(), Counter(), []
    for f in pool:
        first = f.columns[0] if f.columns else ""
        if len(taken) < MOST_SCENES and kinds[f.kind] < PER_KIND and columns[first] < PER_COLUMN:
            taken.append(f)
            kinds[f.kind] += 1
            columns[first] += 1
    taken += [f for f in pool if f not in taken][: max(0, LEAST_SCENES - len(taken))]
    return sorted(taken, key=lambda f: (ARC.index(f.kind) if f.kind in ARC else 5, -f.importance))


def scenes_of_ledgers(facts: DataFrame, by: list[str]) -> DataFrame:
    """(by, scene, seq, kind, columns, importance): select_scenes() for any number of ledgers, whose facts are rows (by,
    seq, kind, columns, importance). A ledger is folded once through its facts in their order; it has some hundred."""
    fact = F.struct((-F.col("importance")).alias("rank"), "seq", "kind", "columns", F.coalesce(F.get("columns", F.lit(0)), F.lit("")).alias("first"), "importance")
    pool = facts.where((F.col("kind") != "overview") & (F.col("importance") >= LEAST_IMPORTANCE)).groupBy(*by).agg(F.array_sort(F.collect_list(fact)).alias("pool"))

    def took(taken, f):
        same = lambda c: F.size(F.filter(taken, lambda x: x[c] == f[c]))
        fits = (F.size(taken) < MOST_SCENES) & (same("kind") < PER_KIND) & (same("first") < PER_COLUMN)
        return F.when(fits, F.concat(taken, F.array(f))).otherwise(taken)

    taken = pool.withColumn("taken", F.aggregate("pool", F.slice("pool", 1, 0), took))
    seqs = F.transform("taken", lambda x: x["seq"])
    rest = F.filter("pool", lambda x: ~F.array_contains(seqs, x["seq"]))
    taken = taken.withColumn("taken", F.concat("taken", F.slice(rest, F.lit(1), F.greatest(F.lit(0), F.lit(LEAST_SCENES) - F.size("taken")))))
    place = F.array_position(F.array(*map(F.lit, ARC)), F.col("f.kind"))
    arc = F.struct(F.when(place > 0, place - 1).otherwise(5), F.col("f.rank"), F.col("f.seq"))
    # seven scenes at most for each ledger
    rows = taken.select(*by, F.explode("taken").alias("f")).withColumn("scene", F.row_number().over(Window.partitionBy(*by).orderBy(arc)))
    return rows.select(*by, "scene", "f.seq", "f.kind", "f.columns", "f.importance")


def direction(f: Fact) -> str | None:
    """up, down or flat by a fact's values, never by its words; null for kinds without a direction."""
    if f.kind in ("trend", "streak", "delta"):
        x, limit = f.values.get("changePct"), DIRECTED
    elif f.kind == "changepoint":
        x, limit = f.values.get("shiftPct"), 0.0
    else:
        return None
    return None if x is None else "up" if x > limit else "down" if x < -limit else "flat"


def claim(f: Fact) -> dict:
    operation, unit = OPERATIONS.get(f.kind, (f.kind, "value"))
    out = {"factId": f.id, "operation": operation, "metric": f.columns[0] if f.columns else "", "unit": unit, "direction": direction(f)}
    if len(f.columns) > 1:
        out["secondaryMetric"] = f.columns[1]
    if f.period:
        out["period"] = dict(f.period)
    if f.category is not None:
        out["category"] = f.category
    return out


def claim_difference(said: dict, meant: dict) -> str | None:
    """The first field in which two claims differ."""
    return next((c for c in CLAIM_FIELDS if said.get(c) != meant.get(c)), None)


# ---- audit ----------------------------------------------------------------------------


def numbers_in(text: str) -> list[float]:
    return [abs(float(x.replace(",", ""))) for x in re.findall(prose.NUMBER, text)]


def _forms(v: float) -> set[float]:
    """What prose.forms_of() gives, for one value."""
    a = abs(v)
    out = {a, abs(show.half_up(v, 0)), abs(show.half_up(v, 1))}
    return out | {show.half_up(a / s, k) for s in (1e3, 1e6, 1e9) if a >= s for k in (1, 2)}


def allowed_numbers(f: Fact) -> set[float]:
    return set().union(*map(_forms, f.values.values())) | set(numbers_in(f.statement))


def stray_numbers(text: str, allowed: set[float]) -> list[float]:
    """The numbers of a text that are near no allowed one."""
    near = lambda n, a: abs(n - abs(a)) <= prose.NEAR or (a != 0 and abs(n - abs(a)) / abs(a) <= prose.NEAR_SHARE)
    return [n for n in numbers_in(text) if not any(near(n, a) for a in allowed)]


def mentions(text: str, name: str) -> bool:
    name = name.strip()
    return len(name) >= 2 and bool(re.search(f"(?<!\\w){re.escape(name)}(?!\\w)", text, re.I))


def metrics_of(facts: list[Fact]) -> list[str]:
    """The measures that a ledger speaks of: both of a correlation, the summed one of a category, none of an overview."""
    out: dict[str, None] = {}
    for f in facts:
        if f.kind == "correlation":
            out |= dict.fromkeys(f.columns)
        elif f.kind in ("category_leader", "concentration"):
            out |= dict.fromkeys(f.columns[1:2])
        elif f.kind != "overview":
            out |= dict.fromkeys(f.columns[:1])
    return list(out)


def objection(f: Fact, text: str, metrics: list[str]) -> str | None:
    """Why a fact doesn't support a text: a stray number, another metric, the wrong way, the wrong sign."""
    if stray := stray_numbers(text, allowed_numbers(f) | FREE_NUMBERS):
        return f"has the number {show.number(stray[0])}, which {f.id} doesn't"
    own = {c.lower() for c in f.columns}
    for m in metrics:
        # a name that the fact's own statement needs is no sign of another metric
        if m.lower() not in own and mentions(text, m) and not mentions(f.statement, m):
            return f"names {m}, but {f.id} measures {', '.join(f.columns)}"
    up, down = bool(re.search(prose.UP, text)), bool(re.search(prose.DOWN, text))
    way = direction(f)
    if (way == "up" and down and not up) or (way == "down" and up and not down):
        return f"points the wrong way for {f.id}"
    if f.kind == "correlation" and (r := f.values.get("r")):
        if re.search(prose.AGAINST if r > 0 else prose.TOGETHER, text):
            return f"has the wrong sign for {f.id}"
    return None


def audit_texts(texts: DataFrame, allowed: DataFrame) -> DataFrame:
    """(text_id, checked, verified) of each text_id: the numbers of its texts (text_id, text), and those of them that
    are near a number of allowed (text_id, number) for that text or (null, number) for all texts.

    The band is cut into cells that grow with the numbers, so that the comparison is an equi-join. The allowed numbers
    are put into the cells around them, and each number of a text meets its own cell's: it is one row before and after,
    and as the left side of a semi-join it is never broadcast, whatever Spark takes the sizes of both sides for.
    """
    said = texts.select("text_id", F.explode_outer(F.array_distinct(prose.numbers_in(F.col("text")))).alias("number"))
    size = lambda x: F.floor(F.log(1.02, x + F.lit(1.0)))
    spoken = said.where("number IS NOT NULL").withColumn("cell", size(F.col("number")))
    a = F.abs(F.col("number"))
    # a number's partners are at most 1.5 % or 0.05 away: two cells up or down at the least width
    cells = F.explode(F.array(*[size(F.col("a")) + k for k in range(-3, 4)]))
    around = allowed.where(finite(a)).select(F.col("text_id").alias("of"), a.alias("a")).distinct().select("of", "a", cells.alias("at"))
    free, own = small_side(around.where("of IS NULL")), around.where("of IS NOT NULL")
    near = (F.col("cell") == F.col("at")) & prose.is_near(F.col("number"), F.col("a"))
    hits = spoken.join(free, near, "left_semi").unionByName(spoken.join(own, near & (F.col("text_id") == F.col("of")), "left_semi"))
    marks = said.withColumn("hit", F.lit(0)).unionByName(hits.select("text_id", "number", F.lit(1).alias("hit")))
    numbers = marks.groupBy("text_id", "number").agg(F.max("hit").alias("hit"))
    return numbers.groupBy("text_id").agg(F.count("number").alias("checked"), F.sum("hit").alias("verified"))


# ---- stories --------------------------------------------------------------------------


def hero(scenes: list[Fact]) -> dict | None:
    """The number that a story opens with."""
    for f in scenes:
        v = f.values
        if f.kind == "trend" and abs(v["changePct"]) >= 5:
            return {"factId": f.id, "value": v["changePct"], "label": f"change of {f.columns[0]}"}
        if f.kind == "category_leader" and v["share"] >= 25:
            return {"factId": f.id, "value": v["share"], "label": f"share of {f.category}"}
        if f.kind == "changepoint":
            return {"factId": f.id, "value": v["shiftPct"], "label": f"new level of {f.columns[0]}"}
        if f.kind == "correlation":
            return {"factId": f.id, "value": v["r"], "label": f"{f.columns[0]} and {f.columns[1]}"}
    return None


def draft_of(raw: str, scenes: int) -> dict | None:
    """The draft in a narrator's answer: the outermost JSON object, whatever stands around it.

    It has a title, a subtitle and as many scenes as asked for, each with headline and body; None otherwise.
    """
    start, end = raw.find("{"), raw.rfind("}")
    try:
        draft = json.loads(raw[start : end + 1]) if 0 <= start < end else None
    except ValueError:
        return None
    if not isinstance(draft, dict) or not all(isinstance(draft.get(k), str) for k in ("title", "subtitle")):
        return None
    made = draft.get("scenes")
    if not isinstance(made, list) or len(made) != scenes:
        return None
    if not all(isinstance(x, dict) and isinstance(x.get("headline"), str) and isinstance(x.get("body"), str) for x in made):
        return None
    said = {k: draft[k] if isinstance(draft.get(k), str) else "" for k in ("title", "subtitle", "closingHeadline", "closingBody")}
    return said | {"scenes": [{"headline": x["headline"], "body": x["body"]} for x in made]}


def told(chosen: list[Fact], narrator: Narrator, metrics: list[str]) -> tuple[dict[str, str], dict[str, int]]:
    """What a narrator says of facts, by id, as far as the audit lets it pass, and the audit's counts."""
    counts = {"checked": 0, "verified": 0, "rewritten": 0, "rejected": 0}
    try:
        texts = narrator(chosen)
        if isinstance(texts, str):
            draft = draft_of(texts, len(chosen))
            texts = {f.id: x["body"] for f, x in zip(chosen, draft["scenes"], strict=True)} if draft else {}
        texts = {k: v for k, v in texts.items() if isinstance(v, str)}
    except Exception:  # whatever goes wrong out there, the own wording is always at hand
        return {}, counts | {"rewritten": len(chosen)}
    out = {}
    for f in chosen:
        text = texts.get(f.id)
        stray = []
        if text:
            found, stray = numbers_in(text), stray_numbers(text, allowed_numbers(f) | FREE_NUMBERS)
            counts["checked"] += len(found)
            counts["verified"] += len(found) - len(stray)
        if text and objection(f, text, metrics) is None:
            out[f.id] = text
        else:
            counts["rewritten"] += 1
            # numbers were right, but not the direction, the sign or the metric
            counts["rejected"] += bool(text) and not stray
    return out, counts


def title_of(chosen: list[Fact], name: str) -> str:
    """A title by the kind of the most important fact."""
    if not chosen:
        return f"What {name} shows"
    top = max(chosen, key=lambda f: f.importance)  # the first of equals
    column = top.columns[0] if top.columns else name
    last = top.columns[1] if len(top.columns) > 1 else column
    titles = {
        "trend": f"{column} on the way {'down' if top.values.get('changePct', 0.0) < 0 else 'up'}",
        "changepoint": f"When {column} changed",
        "outlier": f"{column} and its one odd point",
        "correlation": f"{column} and {last}, side by side",
        "category_leader": f"Who carries {last}",
        "concentration": f"Who carries {last}",
        "seasonal": f"The calendar of {column}",
    }
    return show.shortened(titles.get(top.kind, f"What {name} shows"), TITLE_LENGTH)


def narrate(
    facts: list[Fact],
    name: str,
    narrator: Narrator | None = None,
    metrics: list[str] | None = None,
    tone: str = TONES[0],
    rows: int | None = None,
    counts: dict[str, int] | None = None,
) -> tuple[str, list[dict]]:
    """A title and scenes: an opening, one for each selected fact with its claim, and a closing.

    counts gets the audit's counts, if there is a narrator.
    """
    chosen = select_scenes(facts)
    said, found = told(chosen, narrator, metrics or []) if narrator else ({}, {})
    if counts is not None:
        counts |= found
    title, at = title_of(chosen, name), TONES.index(tone)
    scenes = [{"kind": "hero", "headline": title, "body": "", "factIds": [], "stat": hero(chosen)}]
    for i, f in enumerate(chosen):
        uneven = f.kind == "trend" and f.values["r2"] < 0.5
        kicker = _UNEVEN[at] if uneven else _KICKERS.get(f.kind, ("",) * 3)[at]
        opened = f"{_OPENERS[tone][i % len(_OPENERS[tone])]} {f.statement}"
        # a metric may have the name of any word here: then there are fewer words
        own = (b for b in (f"{opened} {kicker}".strip(), opened) if not objection(f, f"{f.headline} {b}", metrics or []))
        body = said.get(f.id) or next(own, f.statement)
        scenes.append({"kind": "insight", "headline": f.headline, "body": body, "factIds": [f.id], "claim": claim(f)})
    source = f" from {rows} rows" if rows is not None else ""
    closing = f"{len(chosen)} findings out of {len(facts)} computed facts{source}. Each number comes from a fact that can be computed again."
    scenes.append({"kind": "closing", "headline": _CLOSINGS[at], "body": closing, "factIds": []})
    return title, scenes


def create(
    table: Table,
    source: str | None = None,
    question: str | None = None,
    theme: str = "",
    tone: str = "",
    signer=None,
    engine: str = "factloom",
    narrator: Narrator | None = None,
) -> dict:
    """The story of a table as one document; signed if there is a signer.

    source is the text that the table comes from; without one the proof is bound to the table's own digest.
    """
    from . import proof

    if source is not None and not source.strip():
        raise InputError("the text is empty")
    question = show.shortened(question.strip(), QUESTION_LENGTH) if question and question.strip() else None
    name = show.shortened(table.name.strip() or "uploaded data", NAME_LENGTH)
    facts = facts_of(table, question)
    if len(facts) < 2:
        raise InputError("there is too little in this table: it takes a measure with three values")
    tone = tone if tone in TONES else TONES[0]
    rows = int(facts_rows(facts))
    counts = {"checked": 0, "verified": 0, "rewritten": 0, "rejected": 0}
    # verification holds texts against all number columns, so no narrator may name another one either
    metrics = list(dict.fromkeys([*metrics_of(facts), *table.of_kind("number")]))
    title, scenes = narrate(facts, name, narrator, metrics, tone, rows, counts)
    story = {
        "id": "".join(secrets.choice(string.ascii_lowercase + string.digits) for _ in range(10)),
        "createdAt": dt.datetime.now(dt.timezone.utc).isoformat(timespec="seconds"),
        "title": title,
        "question": question,
        "theme": theme if theme in THEMES else THEMES[0],
        "tone": tone,
        "dataset": {
            "name": name,
            "rowCount": rows,
            "columns": [{"name": c, "type": k} for c, k in table.kinds.items()],
            "notes": list(table.notes),
        },
        "facts": [asdict(f) for f in facts],
        "scenes": scenes,
        "audit": counts,
    }
    if signer is not None:
        story["proof"] = proof.sign(table if source is None else source, story, signer, engine)
    return story


def facts_rows(facts: list[Fact]) -> float:
    return next(f.values["rows"] for f in facts if f.kind == "overview")
