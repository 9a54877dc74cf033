"""Operators on DataFrames."""

from vecloom.operators.feed import (
    accumulation_plan,
    assign_shard,
    batch,
    global_index,
    repeat_epochs,
    shuffle_samples,
    shuffle_shards,
    step_plan,
)
from vecloom.operators.images import prepare_images, resize_planes
from vecloom.operators.manifest import (
    latest_checkpoint,
    newest_first,
    parse_manifest,
    retention,
    retention_deletes,
)
from vecloom.operators.models import embed_images, embed_text, embed_tokens, fit_velocity, linear_field, map_rows
from vecloom.operators.rows import (
    cadence,
    drop_blank,
    require_one_of,
    resume_after,
    split_by_rank,
    split_train_eval,
    spread,
    take_first,
    take_images,
)
from vecloom.operators.sampling import euler_fold, euler_sample, euler_snapshots, velocity_at, velocity_loss
from vecloom.operators.stats import (
    accumulate_loss,
    batch_mean_loss,
    evaluate,
    frechet_diagonal,
    frechet_distance,
    moment_states,
    mean_vector,
    tensor_stats,
    vector_moments,
)
from vecloom.operators.vectors import clip_norm, extract_json, map_fields, zip_columns

__all__ = [
    "accumulate_loss",
    "accumulation_plan",
    "assign_shard",
    "batch",
    "batch_mean_loss",
    "cadence",
    "clip_norm",
    "drop_blank",
    "embed_images",
    "embed_text",
    "embed_tokens",
    "euler_fold",
    "euler_sample",
    "euler_snapshots",
    "evaluate",
    "extract_json",
    "fit_velocity",
    "frechet_diagonal",
    "frechet_distance",
    "global_index",
    "moment_states",
    "latest_checkpoint",
    "linear_field",
    "map_fields",
    "map_rows",
    "mean_vector",
    "newest_first",
    "parse_manifest",
    "prepare_images",
    "repeat_epochs",
    "require_one_of",
    "resize_planes",
    "resume_after",
    "retention",
    "retention_deletes",
    "shuffle_samples",
    "shuffle_shards",
    "split_by_rank",
    "split_train_eval",
    "spread",
    "step_plan",
    "take_first",
    "take_images",
    "tensor_stats",
    "vector_moments",
    "velocity_at",
    "velocity_loss",
    "zip_columns",
]
