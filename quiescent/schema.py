"""Schemas of the logical tables, and their validation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T


_TYPES = {
    "string": T.StringType(), "bigint": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(), "boolean": T.BooleanType(),
    "array<double>": T.ArrayType(T.DoubleType()), "map<string,string>": T.MapType(T.StringType(), T.StringType()),
}


def _s(**cols: str) -> T.StructType:
    return T.StructType([T.StructField(k, _TYPES[v]) for k, v in cols.items()])


SAMPLES = _s(rec_id="string", channel="string", i="bigint", v="double")
RECORDINGS = _s(rec_id="string", path="string", srate="double", n_samples="bigint", n_channels="int")
RANGES = _s(rec_id="string", episode_id="int", burst_id="int", start_idx="bigint", end_idx="bigint")
EVENTS = _s(dataset_id="string", event_id="bigint", type="string", latency="double", duration="double", extra="map<string,string>")
CHANNELS = _s(dataset_id="string", idx="int", label="string", x="double", y="double", z="double", theta="double", radius="double", type="string")
POINTS = _s(id="bigint", vec="array<double>", label="int")
SIMILARITY = _s(rec_id="string", sim_fn="string", episode_id="int", a="int", b="int", sim="double")
LEADFIELD = _s(sensor="int", voxel="int", axis="int", w="double")
VOXELS = _s(voxel="int", x="double", y="double", z="double", inside="boolean", tissue_code="int")
ROSC = _s(ptid_og="string", preproc_file="string", time_from_rosc="double")
MERGE_INFO = _s(sid="string", csail_edf_name="string", timestamp="string", nsamples="bigint", is_timestamp_guessed_from_old_edf_name="boolean", is_guessed_timestamp_correct_seeming="boolean")
OUTCOMES = _s(sid="string", bestCpcBy6Mo="int")


def validate(df: DataFrame, schema: T.StructType, extra: bool = True) -> DataFrame:
    """``df`` unchanged if it has the schema's columns with its types; nothing is repaired."""
    have = {f.name: f.dataType for f in df.schema.fields}
    wrong = [f"{f.name}: {have.get(f.name, 'missing')}" for f in schema.fields if have.get(f.name) != f.dataType]
    if not extra:
        wrong += [f"{c}: not asked for" for c in have if c not in schema.names]
    if wrong:
        raise ValueError("; ".join(wrong))
    return df
