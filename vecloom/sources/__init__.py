"""Sources and sinks."""

from vecloom.sources.metrics import list_files, list_manifest, log_metrics
from vecloom.sources.pairs import lookup_rows, read_pairs
from vecloom.sources.shards import (
    expand_braces,
    expand_shards,
    scan_eval_shard,
    scan_shards,
    write_shards,
)
from vecloom.sources.tars import (
    TarShards,
    decode_fields,
    encode_npy,
    index_members,
    read_members,
    register_tars,
    tar_sink,
    tar_source,
)

__all__ = [
    "TarShards",
    "decode_fields",
    "encode_npy",
    "expand_braces",
    "expand_shards",
    "index_members",
    "list_files",
    "list_manifest",
    "log_metrics",
    "lookup_rows",
    "read_members",
    "read_pairs",
    "register_tars",
    "scan_eval_shard",
    "scan_shards",
    "tar_sink",
    "tar_source",
    "write_shards",
]
