"""Build commands: filters, checks, argument cleaning and command-line rewriting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codefacts.functions import paths

#: Extensions of files that are compiled by themselves.
MAIN_EXTENSIONS = (".c", ".C", ".cc", ".cpp", ".CPP", ".cxx", ".c++", ".cu")

#: Flags that are dropped for clang and gcc, and the pattern of others (searched for anywhere).
CLANG_DROP_ONE = ("-march", "-mcpu", "-mtune")
CLANG_DROP_PATTERN = "-m(no-)?fix-.*"

#: Nvcc flags that are dropped alone.
NVCC_DROP_ONE = """
--cuda -cuda --cubin -cubin --fatbin -fatbin --ptx -ptx --optix-ir -optix-ir --generate-dependencies --compile --device-c -dc --device-w -dw
--device-link -dlink --link -link --lib -lib --run -run --output-file --compiler-bindir -ccbin --allow-unsupported-compiler --archiver-binary -arbin
--use-local-env -use-local-env --profile -pg --debug --device-debug -G --generate-line-info --dlink-time-opt -dlto --gen-opt-lto -gen-opt-lto
--no-host-device-initializer-list -nohdinitlist --no-host-device-move-forward -nohdmvforward --expt-relaxed-constexpr -expt-relaxed-constexpr
--extended-lambda -extended-lambda --expt-extended-lambda -expt-extended-lambda --m64 -m64 --forward-unknown-to-host-compiler
-forward-unknown-to-host-compiler --forward-unknown-opts -forward-unknown-opts --keep -keep --save-temps -save-temps --no-align-double -no-align-double
--no-device-link -nodlink --extra-device-vectorization -extra-device-vectorization --disable-warnings -w --keep-device-functions -keep-device-functions
--source-in-ptx -src-in-ptx --restrict -restrict --Wreorder -Wreorder --Wdefault-stream-launch -Wdefault-stream-launch --Wmissing-launch-bounds
-Wmissing-launch-bounds --Wext-lambda-captures-this -Wext-lambda-captures-this --Wno-deprecated-declarations -Wno-deprecated-declarations
--Wno-deprecated-gpu-targets -Wno-deprecated-gpu-targets --resource-usage -res-usage --extensible-whole-program -ewp --compress-all -compress-all
--no-compress -no-compress --qpp-config -qpp-config --compile-as-tools-patch -astoolspatch --display-error-number -err-no --no-display-error-number
-no-err-no --augment-host-linker-script -aug-hls --host-relocatable-link -r
""".split()

#: Nvcc flags that are dropped with the argument after them (or after "=").
NVCC_DROP_TWO = """
--cudart -cudart --cudadevrt -cudadevrt --libdevice-directory -ldir --target-directory -target-dir --optimization-info --optimize --dopt -dopt
--machine -m --threads -t --split-compile -split-compile --keep-dir -keep-dir --compiler-options -Xcompiler --options-file --fatbin-options -Xfatbin
--linker-options --archive-options -Xarchive --ptxas-options -Xptxas --nvlink-options -Xnvlink --time -time --run-args -run-args --input-drive-prefix
-idp --dependency-drive-prefix -ddp --drive-prefix -dp -dependency-target-name --gpu-architecture --gpu-code -code --generate-code -gencode
--relocatable-device-code -rdc --entries -e --maxrregcount -maxrregcount --use_fast_math -use_fast_math --ftz -ftz --prec-div -prec-div --prec-sqrt
-prec-sqrt --fmad -fmad --default-stream -default-stream --Werror -Werror --diag-error -diag-error --diag-suppress -diag-suppress --diag-warn
-diag-warn --host-linker-script -hls --brief-diagnostics -brief-diag
""".split()


def is_main_file(file: Column) -> Column:
    """A file that is compiled by itself: a known extension, case counts, after at least one character."""
    return file.rlike(".(" + "|".join(x.replace(".", "[.]").replace("+", "[+]") for x in MAIN_EXTENSIONS) + ")$")


def missing_keys(commands: DataFrame) -> DataFrame:
    """Rows that lack a required key, with the names of those that are missing."""
    lacks = F.array_compact(
        F.array(
            F.when(F.col("directory").isNull(), F.lit("directory")),
            F.when(F.col("file").isNull(), F.lit("file")),
            F.when(F.col("command").isNull() & F.col("arguments").isNull(), F.lit("command")),
        )
    )
    return commands.withColumn("missing", lacks).where(F.size("missing") > 0)


def unknown_keys(objects: DataFrame, known: tuple[str, ...] = ("directory", "file", "command", "arguments", "output")) -> DataFrame:
    """Keys of JSON texts (column json) that no reader knows, each once, sorted."""
    keys = objects.select(F.explode(F.json_object_keys("json")).alias("key"))
    return keys.where(~F.col("key").isin(*known)).distinct().orderBy("key")


def badly_typed(objects: DataFrame) -> DataFrame:
    """JSON objects (column json) with a value that is neither a string nor an array of strings."""
    fields = F.from_json("json", "map<string, variant>")
    kind = F.transform_values(fields, lambda _, v: F.schema_of_variant(v))
    return objects.withColumn("bad", F.map_keys(F.map_filter(kind, lambda _, v: ~v.isin("STRING", "ARRAY<STRING>", "ARRAY<VOID>")))).where(F.size("bad") > 0)


def skip_reasons(commands: DataFrame, existing: DataFrame) -> DataFrame:
    """commands with the reason to skip them: not-main, then missing file (existing: path), else null."""
    path = F.when(F.startswith("file", F.lit("/")), F.col("file")).otherwise(paths.join(F.col("directory"), F.col("file")))
    found = commands.withColumn("path", path).join(existing.select("path").distinct().withColumn("exists", F.lit(True)), "path", "left")
    return found.withColumn("skipped", F.when(~is_main_file(F.col("file")), "not-main").when(F.col("exists").isNull(), "no-file")).drop("exists")


def _starts_drop(arg: Column, one: list[str] | tuple[str, ...], two: list[str], pattern: str | None) -> Column:
    """0: keep, 1: drop, 2: drop with the next."""
    flag, alone = F.substring_index(arg, "=", 1), ~arg.contains("=")
    out = F.when(~arg.startswith("-"), 0)
    if pattern:
        out = out.when(alone & arg.rlike(pattern), 1)
    if two:
        out = out.when(flag.isin(*two), F.when(alone, 2).otherwise(1))
    return out.when(flag.isin(*one), 1).otherwise(0)


def clean_arguments(arguments: Column, kind: Column) -> Column:
    """Arguments without those that other compilers wouldn't take; kind is clang, gcc, nvcc or null (kept as they are).

    A fold from the left: an argument that is dropped because of the one before it never starts a drop itself.
    """

    def fold(drop):
        start = F.struct(F.lit(False).alias("skip"), F.array().cast("array<string>").alias("out"))

        def step(acc, arg):
            action = F.when(acc["skip"], 1).otherwise(drop(arg))
            return F.struct((action == 2).alias("skip"), F.when(action == 0, F.concat(acc["out"], F.array(arg))).otherwise(acc["out"]).alias("out"))

        return F.aggregate(arguments, start, step, lambda acc: acc["out"])

    clang = fold(lambda a: _starts_drop(a, CLANG_DROP_ONE, [], CLANG_DROP_PATTERN))
    nvcc = fold(lambda a: _starts_drop(a, NVCC_DROP_ONE, NVCC_DROP_TWO, None))
    return F.when(kind.isin("clang", "gcc"), clang).when(kind == "nvcc", nvcc).otherwise(arguments)


def compiler_kind(compiler: Column) -> Column:
    """The kind by the name of the program, tried in the order clang, gcc, nvcc; null for others."""
    name = F.substring_index(compiler, "/", -1)
    return F.when(name.rlike("clang"), "clang").when(name.rlike("gcc|g[+][+]|^cc$|^c[+][+]$"), "gcc").when(name.rlike("nvcc"), "nvcc")


def toolchains(commands: DataFrame) -> DataFrame:
    """One row per different compiler with its kind, failures (null) included."""
    return commands.select(F.get("arguments", 0).alias("compiler")).distinct().withColumn("kind", compiler_kind(F.col("compiler")))


def rewrite(commands: DataFrame, known: DataFrame) -> DataFrame:
    """commands with the arguments that the front end is given; known: compiler, kind, driver, resource_dir, cuda_dir.

    The compilers are a dimension with a row each, so each is inferred once; unknown ones keep their commands.
    """
    both = commands.withColumn("compiler", F.get("arguments", 0)).join(known, "compiler", "left")
    cleaned = clean_arguments(F.col("arguments"), F.col("kind"))
    tail = F.slice(cleaned, 2, F.greatest(F.size(cleaned) - 1, F.lit(0)))
    resource = F.array(F.lit("-resource-dir"), F.col("resource_dir"))
    clang = F.concat(F.array("driver"), tail, resource)
    out = F.when(F.col("kind") == "clang", clang).when(F.col("kind") == "gcc", F.concat(cleaned, resource, F.array(F.concat(F.lit("-I"), "resource_dir", F.lit("/include-fixed")))))
    out = out.when(F.col("kind") == "nvcc", F.concat(clang, F.array(F.concat(F.lit("-isystem"), "cuda_dir", F.lit("/include"))))).otherwise(F.col("arguments"))
    return both.withColumn("arguments", out)


def with_front_end_flags(arguments: Column, directory: Column) -> Column:
    """What every unit is compiled with: syntax only, no warnings, its directory, no limit of errors."""
    return F.concat(arguments, F.array(F.lit("-fsyntax-only"), F.lit("-w"), F.lit("-working-directory"), directory, F.lit("-ferror-limit=0")))


def unexpanded(arguments: Column) -> Column:
    """Whether an argument looks like a variable of a makefile that nothing has replaced."""
    return F.exists(arguments, lambda a: a.rlike(r"^\$\(.*\)$"))


def matches_header_filter(path: Column, pattern: str) -> Column:
    """A match of the whole path; an empty pattern matches nothing."""
    return path.rlike(f"^({pattern})$") if pattern else F.lit(False)
