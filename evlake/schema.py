"""Record formats: fixed values, expected fields per level, and the tables they become."""

from __future__ import annotations

# Fixed values of the stored format.
FORMAT_VERSION = 4
POINTER_VERSION = 1
MAX_HEADER_BYTES = 1 << 20
MAX_MANIFEST_BYTES = 128 << 20
TARGET_KINDS = ("lib", "bin", "example", "bench")
ARTIFACT_KINDS = ("source", "llvm")
STAGES = ("no_lto_optimized", "local_thin_lto_post_pass_manager")
LTO_MODES = ("off", "local_thin", "cross_crate_thin", "fat")
STAGE_OF_LTO = (("no_lto_optimized", "off"), ("local_thin_lto_post_pass_manager", "local_thin"))
OPTIMIZATIONS = ("0", "1", "2", "3", "s", "z")
DEFINITION_KINDS = ("function", "direct_alias", "expression_alias", "ifunc")

# Fields of each record level. Strict levels refuse any other field.
HEADER_FIELDS = ("format_version", "id", "completed_at_unix_ms", "build", "compiler", "analysis")
BUILD_FIELDS = (
    "package",
    "package_version",
    "target",
    "profile",
    "cargo_program",
    "invocation_directory",
    "cargo_arguments",
)
TARGET_FIELDS = ("name", "kind")
COMPILER_FIELDS = ("rustc", "release", "commit_hash", "host", "sysroot")
ANALYSIS_FIELDS = ("request_key", "token", "artifact")
MANIFEST_FIELDS = (
    "format_version",
    "capture_id",
    "instances",
    "artifacts",
    "llvm_provenance",
    "llvm",
)
INSTANCE_FIELDS = ("definition", "display_name", "raw_symbol", "placements", "source")
DEFINITION_NAME_FIELDS = ("crate_name", "definition_path")
PLACEMENT_FIELDS = ("codegen_unit", "linkage", "visibility", "local_copy", "size_estimate")
SOURCE_FIELDS = ("artifact", "range", "display_path", "starting_line")
RANGE_FIELDS = ("start", "length")
ARTIFACT_FIELDS = ("id", "kind", "byte_len")
MODULE_FIELDS = ("artifact", "compiler_module", "stage", "definitions")
MODULE_DEFINITION_FIELDS = ("raw_symbol", "range", "kind")
PROVENANCE_FIELDS = (
    "backend",
    "llvm_version",
    "target",
    "optimization",
    "lto",
    "incremental",
    "linker_plugin_lto",
    "codegen_units",
    "recipe_revision",
)
POINTER_FIELDS = ("format_version", "request_key", "token", "capture_id")

# Unsigned 64-bit numbers are read exactly; tables keep BIGINT after the range rule.
U64 = "decimal(20,0)"

BUILD_TYPE = (
    "struct<package:string,package_version:string,target:struct<name:string,kind:string>,"
    "profile:string,cargo_program:string,invocation_directory:string,"
    "cargo_arguments:array<string>>"
)
COMPILER_TYPE = "struct<rustc:string,release:string,commit_hash:string,host:string,sysroot:string>"
OBSERVED_TARGET_TYPE = (
    "struct<kind:array<string>,crate_types:array<string>,name:string,"
    "required_features:array<string>,src_path:string,edition:string,doc:boolean,"
    "doctest:boolean,test:boolean>"
)
OBSERVATION_TYPE = (
    f"struct<package_id:string,manifest_path:string,target:{OBSERVED_TARGET_TYPE},"
    "profile:struct<opt_level:string,debuginfo:string,debug_assertions:boolean,"
    "overflow_checks:boolean,test:boolean>,features:array<string>,filenames:array<string>,"
    "executable:string,fresh:boolean>"
)
# The observation comes from another program, whose spelling of one field has a hyphen.
OBSERVATION_JSON = OBSERVATION_TYPE.replace("required_features", "`required-features`")

VIOLATIONS = "capture_id string, rule string, entity string, detail string"
