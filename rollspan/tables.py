"""Fixed schemas and vocabularies of the canonical tables."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

# The vocabularies of the stored string columns.
SPLITS = ("train", "validation", "test")
TIME_UNITS = ("frame", "ps", "ns")
SAMPLING = ("verified", "assumed", "unavailable")
METRICS = ("mae", "rmse", "scaled-mae", "pinball", "coverage", "width")
ROLE_SPLITS = {
    "train": "train",
    "validation": "validation",
    "calibration": "validation",
    "confirmation": "test",
}
PURPOSE_ROLES = {
    "tuning": ("train", "validation"),
    "calibration": ("calibration",),
    "confirmation": ("confirmation",),
}

WINDOW_KEY = ("trajectory_id", "start", "context_frames", "horizon_frames")
CELL = ("context_frames", "horizon_frames")


_TYPES = {"string": T.StringType(), "int": T.IntegerType(), "double": T.DoubleType()}


def _schema(required, optional):
    """Fixed schema from `name:type` words."""
    fields = []
    for words, nullable in ((required, False), (optional, True)):
        for word in words.split():
            name, kind = word.split(":")
            fields.append(T.StructField(name, _TYPES[kind], nullable))
    return T.StructType(fields)


TRAJECTORIES = _schema(
    "trajectory_id:string dataset_id:string system_id:string frame_count:int "
    "time_unit:string sampling_status:string",
    "dataset_version:string feature_set_version:string replicate_id:string "
    "split_group_id:string entity_id:string ligand_id:string protein_id:string "
    "split:string frame_interval_ps:double duration_ns:double sampling_note:string "
    "source_record:string source_checksum:string license_id:string provenance_uri:string",
)

FEATURES = _schema(
    "dataset_id:string feature_id:string ordinal:int unit:string",
    "description:string definition:string",
)


def frames_schema(features, dataset=True):
    """Schema of `frames`: identity, time and one double per feature."""
    fields = [
        T.StructField("trajectory_id", T.StringType(), False),
        T.StructField("frame", T.LongType(), False),
        T.StructField("time", T.DoubleType(), False),
    ]
    fields += [T.StructField(name, T.DoubleType(), False) for name in features]
    if dataset:
        fields.append(T.StructField("dataset_id", T.StringType(), False))
    return T.StructType(fields)


def feature_columns(frames):
    """Feature columns of a wide `frames` table, in table order."""
    fixed = {"trajectory_id", "dataset_id", "frame", "time", "block", "own"}
    return [name for name in frames.columns if name not in fixed]


def conform(df, schema):
    """Select and cast to a fixed schema; absent nullable columns become null."""
    columns = []
    for field in schema.fields:
        if field.name in df.columns:
            columns.append(F.col(field.name).cast(field.dataType).alias(field.name))
        elif field.nullable:
            columns.append(F.lit(None).cast(field.dataType).alias(field.name))
        else:
            raise ValueError(f"required column {field.name} is absent")
    return df.select(*columns)
