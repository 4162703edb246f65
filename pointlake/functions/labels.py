"""The label ontology: names, colours, training ids, canonical classes and packed labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Ids and names of the public label set.
NAMES = {
    0: "unlabeled", 1: "outlier", 10: "car", 11: "bicycle", 13: "bus", 15: "motorcycle", 16: "on-rails", 18: "truck", 20: "other-vehicle",
    30: "person", 31: "bicyclist", 32: "motorcyclist", 40: "road", 44: "parking", 48: "sidewalk", 49: "other-ground", 50: "building",
    51: "fence", 52: "other-structure", 60: "lane-marking", 70: "vegetation", 71: "trunk", 72: "terrain", 80: "pole", 81: "traffic-sign",
    99: "other-object", 252: "moving-car", 253: "moving-bicyclist", 254: "moving-person", 255: "moving-motorcyclist", 256: "moving-on-rails",
    257: "moving-bus", 258: "moving-truck", 259: "moving-other-vehicle",
}
# Colours as blue, green, red.
COLORS = {
    0: (0, 0, 0), 1: (0, 0, 255), 10: (245, 150, 100), 11: (245, 230, 100), 13: (250, 80, 100), 15: (150, 60, 30), 16: (255, 0, 0),
    18: (180, 30, 80), 20: (255, 0, 0), 30: (30, 30, 255), 31: (200, 40, 255), 32: (90, 30, 150), 40: (255, 0, 255), 44: (255, 150, 255),
    48: (75, 0, 75), 49: (75, 0, 175), 50: (0, 200, 255), 51: (50, 120, 255), 52: (0, 150, 255), 60: (170, 255, 150), 70: (0, 175, 0),
    71: (0, 60, 135), 72: (80, 240, 150), 80: (150, 240, 255), 81: (0, 0, 255), 99: (255, 255, 50), 252: (245, 150, 100), 253: (200, 40, 255),
    254: (30, 30, 255), 255: (90, 30, 150), 256: (255, 0, 0), 257: (250, 80, 100), 258: (180, 30, 80), 259: (255, 0, 0),
}
# Label id -> training id.
TRAINING = {
    0: 0, 1: 0, 10: 1, 11: 2, 13: 5, 15: 3, 16: 5, 18: 4, 20: 5, 30: 6, 31: 7, 32: 8, 40: 9, 44: 10, 48: 11, 49: 12, 50: 13, 51: 14, 52: 0,
    60: 9, 70: 15, 71: 16, 72: 17, 80: 18, 81: 19, 99: 0, 252: 1, 253: 7, 254: 6, 255: 8, 256: 5, 257: 5, 258: 4, 259: 5,
}
# Training id -> label id.
TRAINING_INVERSE = {0: 0, 1: 10, 2: 11, 3: 15, 4: 18, 5: 20, 6: 30, 7: 31, 8: 32, 9: 40, 10: 44, 11: 48, 12: 49, 13: 50, 14: 51, 15: 70, 16: 71, 17: 72, 18: 80, 19: 81}
# Moving id -> class it counts as. 256 goes with motorcycles as published; CORRECTED sends it to on-rails.
CANONICAL = {252: 10, 253: 31, 254: 30, 255: 32, 256: 15, 257: 13, 258: 18, 259: 20}
CORRECTED = CANONICAL | {256: 16}
# Sequences of each split.
SPLITS = {"train": (0, 1, 2, 3, 4, 5, 6, 7, 9, 10), "valid": (8,), "test": (11, 12, 13, 14, 15, 16, 17, 18, 19, 20, 21)}
# Ids that each evaluation target admits.
TARGETS = {
    "car": (10, 252), "person": (30, 254), "bicyclist": (31, 253), "bicycle": (11,), "motorcycle": (15, 255), "motorcyclist": (32, 255),
    "bus": (13, 257), "truck": (18, 258), "other_vehicle": (20, 259),
}
#: Countable objects.
THINGS = tuple(i for i in NAMES if 10 <= i <= 32 or i >= 252)
CAR, PERSON = 10, 30


def dimension(spark: SparkSession) -> DataFrame:
    """One row a label: semantic_id, name, training_id, thing, blue, green, red. 34 rows, safe to broadcast."""
    rows = [(i, n, TRAINING[i], i in THINGS, *COLORS[i]) for i, n in NAMES.items()]
    return spark.createDataFrame(rows, "semantic_id int, name string, training_id int, thing boolean, blue int, green int, red int")


def lookup(table: dict, key: Column) -> Column:
    """table[key], null if absent, as a literal map."""
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), key.cast("int"))


def semantic_of(raw: Column) -> Column:
    return raw.cast("long").bitwiseAND(F.lit(65535)).cast("int")


def instance_of(raw: Column) -> Column:
    return F.shiftrightunsigned(raw.cast("long").bitwiseAND(F.lit(0xFFFFFFFF)), 16).cast("int")


def packed(semantic: Column, instance: Column) -> Column:
    low, high = (c.cast("long").bitwiseAND(F.lit(65535)) for c in (semantic, instance))
    return low.bitwiseOR(F.shiftleft(high, 16))


def training_of(semantic: Column, strict: bool = False) -> Column:
    """Training id; an id out of the table is 0, or an error if ``strict``."""
    got = lookup(TRAINING, semantic)
    if strict:
        return F.coalesce(got, F.raise_error(F.concat(F.lit("label out of table: "), semantic.cast("string"))).cast("int"))
    return F.coalesce(got, F.lit(0))


def label_of_training(training: Column) -> Column:
    return F.coalesce(lookup(TRAINING_INVERSE, training), F.lit(0))


def canonical(semantic: Column, table: dict = CANONICAL) -> Column:
    return F.coalesce(lookup(table, semantic), semantic.cast("int"))


def same_class(a: Column, b: Column) -> Column:
    return (canonical(a) == canonical(b)) & (canonical(a) != 0)


def name_of(semantic: Column) -> Column:
    return F.coalesce(lookup(NAMES, semantic), F.concat(F.lit("unknown-"), semantic.cast("string")))


def is_thing(semantic: Column) -> Column:
    return semantic.isin(*THINGS)


def normalise_target(name: str) -> str:
    """Lower case, spaces and hyphens as underscores, and common synonyms."""
    key = name.strip().lower().replace(" ", "_").replace("-", "_")
    return {"pedestrian": "person", "cyclist": "bicyclist"}.get(key, key)


def target_ids(names: list[str] | dict | str) -> set[int]:
    """All ids of the named targets; a dict names those with a true value."""
    listed = [names] if isinstance(names, str) else [n for n, on in names.items() if on] if isinstance(names, dict) else list(names)
    by_name = {normalise_target(n): (i,) for i, n in NAMES.items()}
    out: set[int] = set()
    for n in dict.fromkeys(normalise_target(x) for x in listed):
        ids = TARGETS.get(n) or by_name.get(n)
        if not ids:
            raise ValueError(f"unknown target: {n}")
        out.update(ids)
    return out


def admits(semantic: Column, ids: set[int]) -> Column:
    """Whether an id, or its canonical class, is among the targets or their canonical classes."""
    classes = {CANONICAL.get(i, i) for i in ids}
    return semantic.isin(*sorted(ids)) | canonical(semantic).isin(*sorted(classes))


def class_from_size(semantic: Column, volume: Column, height: Column, default: int = CAR) -> Column:
    """A positive id stands; else a person by volume 0.1 to 2 and height from 1.2; else a car by volume 2 to 80; else the default."""
    return (
        F.when(semantic > 0, semantic)
        .when(volume.between(0.1, 2.0) & (height >= 1.2), F.lit(PERSON))
        .when(volume.between(2.0, 80.0), F.lit(CAR))
        .otherwise(F.lit(default))
        .cast("int")
    )


def class_from_record(semantic: Column, class_id: Column, class_name: Column, volume: Column, height: Column) -> Column:
    """The class of a box record: a positive semantic or class id, else the least id of the named target or label, else from its size."""
    names = {n.replace("-", "_"): i for i, n in NAMES.items() if i > 0} | {n: min(ids) for n, ids in TARGETS.items()}
    names |= {"pedestrian": names["person"], "cyclist": names["bicyclist"]}
    key = F.translate(F.lower(F.trim(class_name)), " -", "__")
    pairs = [F.lit(x) for kv in names.items() for x in kv]
    named = F.try_element_at(F.create_map(*pairs), key)
    return class_from_size(F.coalesce(F.when(semantic > 0, semantic), F.when(class_id > 0, class_id), named, F.lit(0)), volume, height)


def load_ontology(path: str) -> dict[str, dict]:
    """The tables of an ontology file (YAML): labels, color_map, learning_map, learning_map_inv, content, learning_ignore and split; those it lacks are empty."""
    import yaml

    with open(path, encoding="utf-8") as f:
        got = yaml.safe_load(f) or {}
    if not isinstance(got, dict) or "labels" not in got:
        raise ValueError(f"{path} has no labels")
    return {k: got.get(k, {}) for k in ("labels", "color_map", "learning_map", "learning_map_inv", "content", "learning_ignore", "split")}


def ontology_dimension(spark: SparkSession, tables: dict[str, dict]) -> DataFrame:
    """``dimension`` from the tables of a file: one row a label, so it is safe to broadcast."""
    colour = lambda i: tuple(tables["color_map"].get(i, (128, 128, 128)))
    rows = [(int(i), str(n), int(tables["learning_map"].get(i, 0)), int(i) in THINGS, *map(int, colour(i))) for i, n in tables["labels"].items()]
    return spark.createDataFrame(rows, "semantic_id int, name string, training_id int, thing boolean, blue int, green int, red int")


def split_sequences(split: str) -> tuple[int, ...]:
    if split not in SPLITS:
        raise ValueError(f"unknown split: {split}")
    return SPLITS[split]
