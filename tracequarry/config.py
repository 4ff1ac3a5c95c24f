"""Values that results depend on, and the tables of backends and stages."""

from __future__ import annotations

# Fixed values of the trace format: names, fields, limits and thresholds.
LOG_PREFIX = "dedicated_log_triton_trace_"
AUTOTUNER_FILE = "triton/runtime/autotuner.py"
SUMMARY_FIELDS = ("pid", "timestamp", "stream", "function", "data_ptr")
EXCLUDED_FIELDS = ("occurrence_id", "launch_group_hash", "autotune_launch_type")
VOLATILE_FIELDS = ("timestamp", "pid", "launch_group_hash", "occurrence_id", "function")
MAX_VALUE_CHARS = 4096
CONFIG_FIELDS = ("num_warps", "num_stages", "num_ctas", "maxnreg")
METADATA_FIELDS = (
    "num_stages", "num_warps", "num_ctas", "maxnreg", "num_buffers_warp_spec", "num_consumer_groups",
    "reg_dec_producer", "reg_inc_consumer", "cluster_dims", "target", "shared", "src_constants", "src_attrs",
)
SOURCE_SIMILARITY = 0.75
NAME_SIMILARITY = 0.70
GROUP_SAMPLES = 5
HIGHLIGHT_PER_CENT = 20
ATOL, RTOL = 1e-5, 1e-3

# Operations by stage.
OPERATIONS = {
    "ttir": r"(tt\.\w+|arith\.\w+|scf\.\w+|cf\.\w+)",
    "ttgir": r"(ttg\.\w+|tt\.\w+|arith\.\w+|scf\.\w+|cf\.\w+)",
    "llir": r"(define|call|load|store|alloca|getelementptr|br|ret|icmp|fcmp|add|sub|mul|div|and|or|xor|shl|lshr|ashr)",
    "ptx": r"(ld\.|st\.|mov\.|add\.|sub\.|mul\.|mad\.|fma\.|cvt\.|setp\.|bra|ret|bar\.sync|cp\.async)",
    "amdgcn": r"(v_\w+|s_\w+|ds_\w+|buffer_\w+|global_\w+|flat_\w+)",
}

# Bits of element types, by the first name that the type's text holds.
DTYPE_BITS = (
    ("f16", 16), ("bf16", 16), ("f32", 32), ("f64", 64), ("fp16", 16), ("bfloat16", 16), ("fp32", 32), ("fp64", 64),
    ("i8", 8), ("i16", 16), ("i32", 32), ("i64", 64), ("int8", 8), ("int16", 16), ("int32", 32), ("int64", 64),
    ("f8e4m3fnuz", 8), ("f8e5m2fnuz", 8), ("f8e4m3fn", 8), ("f8e5m2", 8),
)

# Stages of each backend as (name, extension, order, text, source mapping, parser).
BACKEND_STAGES = {
    "cuda": (
        ("ttir", ".ttir", 10, True, True, "generic_loc"),
        ("ttgir", ".ttgir", 20, True, True, "generic_loc"),
        ("llir", ".llir", 30, True, True, "generic_loc"),
        ("ptx", ".ptx", 40, True, True, "ptx_loc"),
        ("cubin", ".cubin", 50, False, False, "none"),
        ("sass", ".sass", 60, True, True, "sass_loc"),
        ("json", ".json", 100, True, False, "none"),
    ),
    "hip": (
        ("ttir", ".ttir", 10, True, True, "generic_loc"),
        ("ttgir", ".ttgir", 20, True, True, "generic_loc"),
        ("llir", ".llir", 30, True, True, "generic_loc"),
        ("amdgcn", ".amdgcn", 40, True, True, "amdgcn_loc"),
        ("json", ".json", 100, True, False, "none"),
    ),
    "cann": (
        ("ttir", ".ttir", 10, True, True, "generic_loc"),
        ("ttadapter", ".ttadapter", 20, True, True, "generic_loc"),
        ("mlirbc", ".mlirbc", 30, False, False, "none"),
        ("bcmlir", ".bcmlir", 40, True, True, "generic_loc"),
        ("npubin", ".npubin", 50, False, False, "none"),
        ("json", ".json", 100, True, False, "none"),
    ),
}


def enabled(setting: str | None, default: str = "all") -> frozenset[str] | None:
    """A comma list of names: None stands for all. ``all`` wins, then ``none``; case counts for
    nothing."""
    names = {x.strip().lower() for x in (setting if setting is not None else default).split(",") if x.strip()}
    if "all" in names:
        return None
    return frozenset() if "none" in names else frozenset(names)
