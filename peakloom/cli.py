"""Command line: peak lists in, result tables out."""

from __future__ import annotations

import argparse
import sys
from collections.abc import Sequence

from .operators.fit import FitConfig
from .plans.solve import SolveConfig

VERSION = "0.1.0"


def counted_list(text: str) -> tuple[tuple[str, ...], tuple[int | None, ...]]:
    """Names or masses with optional limits, a:3,b."""
    parts = [p.strip().partition(":") for p in text.split(",") if p.strip()]
    return tuple(p[0] for p in parts), tuple(int(p[2]) if p[2] else None for p in parts)


def composition(text: str) -> dict[str, int]:
    """Hex:3,HexNAc:2."""
    names, counts = counted_list(text)
    return {n: 1 if c is None else c for n, c in zip(names, counts)}


def sniffed(filename: str) -> tuple[str | None, str | None]:
    """S18 for one name."""
    if not filename.lower().endswith(".msd"):
        return None, None
    mode = "neg_h" if "LN_" in filename or "RN_" in filename else "pos_na" if "LP_" in filename or "RP_" in filename else None
    return mode, "2aa_nr" if "_2aa" in filename.lower() else None


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="peakloom", description="Explain peak masses as a common part plus blocks.")
    add = p.add_argument
    add("-p", "--peaks", help="peak list, text or .msd, or a folder of them")
    add("-o", "--output", default="output")
    add("-D", "--mode", choices=["pos_na", "pos_h", "neg_h"])
    add("-X", "--matrix", choices=["2aa_nr", "2aa_r"])
    add("-d", "--dictionary")
    add("-c", "--common", type=composition, default={"Hex": 3, "HexNAc": 2})
    add("-n", "--names", default="Hex", help="known blocks, with limits: Hex:8,HexNAc")
    add("-m", "--masses", default="", help="known masses, with limits: 162.05:8")
    add("-u", "--unknown", type=int, default=3)
    add("-t", "--tolerance", type=float, default=0.3)
    add("-f", "--final-tolerance", type=float, default=0.5)
    add("-b", "--bad", type=int, default=0)
    add("-A", "--postgoal", type=int, default=20)
    add("-K", "--max-known", type=int, default=10)
    add("-L", "--lower-bound", type=float, default=35)
    add("-M", "--upper-bound", type=float, default=370)
    add("-I", "--min-diff", type=float, default=40)
    add("-C", "--candidates-only", action="store_true")
    add("-U", "--max-unknown", type=int, default=4)
    add("-T", "--timeout", type=int, help="taken for compatibility; a job has no time limit here")
    add("-v", "--verbose", action="store_true", help="name each file written")
    add("-e", "--exclude", default="")
    add("--protect", default="")
    add("--exhaustive", type=int, choices=[0, 1, 2], default=1)
    add("--sanity-check", action="store_true")
    add("--glycan-type", choices=["native", "permethylated", "peracetylated"], default="native")
    add("--version", action="version", version=VERSION)
    return p


def config_of(args: argparse.Namespace) -> SolveConfig:
    names, name_limits = counted_list(args.names)
    masses, mass_limits = counted_list(args.masses)
    mode, matrix = sniffed((args.peaks or "").rsplit("/", 1)[-1])
    limits = tuple(args.max_known if x is None else x for x in (*name_limits, *mass_limits))
    listed = lambda text: tuple(x.strip() for x in text.split(",") if x.strip())
    return SolveConfig(
        mode=args.mode or mode, matrix=args.matrix or matrix, composition=args.common, names=names, masses=tuple(map(float, masses)), known_limits=limits, exclude=listed(args.exclude), protect=listed(args.protect),
        max_added=args.unknown, min_diff=args.min_diff, exhaustive=args.exhaustive, sanity_check=args.sanity_check, glycan_type=args.glycan_type, dictionary=args.dictionary,
        fit=FitConfig(tolerance=args.tolerance, final_tolerance=args.final_tolerance, max_known=args.max_known, max_unknown=args.max_unknown, lower=args.lower_bound, upper=args.upper_bound, bad_allowed=args.bad, postgoal=args.postgoal),
    )


def merged_selection(exclude: Sequence[str], selected: Sequence[str], deselected: Sequence[str]) -> tuple[list[str], list[str]]:
    """selected candidates leave the exclusions and are protected; deselected ones are excluded."""
    chosen = {s.lower() for s in selected}
    kept = [x for x in exclude if x.lower() not in chosen]
    return kept + [d for d in deselected if d not in kept], list(selected)


def form_config(form: dict[str, str], blocks: Sequence[str]) -> dict[str, tuple[str, ...]]:
    """A form's tri-state fields block_<name> (use, discover or exclude) as names and exclusions."""
    state = {b: form.get(f"block_{b}", "discover") for b in blocks}
    return {"names": tuple(b for b, s in state.items() if s == "use"), "exclude": tuple(b for b, s in state.items() if s == "exclude")}


def main(argv: Sequence[str] | None = None) -> int:
    argv = sys.argv[1:] if argv is None else list(argv)
    if not argv:
        parser().print_help()
        return 1
    args = parser().parse_args(argv)
    if args.timeout is not None:
        print("-T has no effect: a job has no time limit here", file=sys.stderr)
    from pyspark.sql import SparkSession

    from .operators import candidates
    from .plans.solve import resolved, solve
    from .sinks.analysis import write_analysis
    from .sinks.files import output_folder
    from .sinks.tables import candidates_file, write_tsv
    from .sources.peaks import msd_peaks, text_peaks

    spark = SparkSession.builder.appName("peakloom").getOrCreate()
    try:
        config = config_of(args)
        output_folder(args.output)
        peaks = (msd_peaks if args.peaks.lower().endswith(".msd") else text_peaks)(spark, args.peaks)
        if args.candidates_only:
            book, config = resolved(spark, config)
            ranked, rejected = candidates.discover(peaks, book, config.common, config.masses, config.min_diff, config.fit.lower, config.fit.upper)
            write_tsv(candidates_file(ranked, rejected), f"{args.output}/candidates.tsv", True)
            return 0
        tables = solve(peaks, config)
        for name in write_analysis(tables, *resolved(spark, config), args.output):
            if args.verbose:
                print(f"{args.output}/{name}")
        for name in ("facts", "models", "peak_stats", "dependencies", "network", "blocks"):
            tables[name].write.mode("overwrite").parquet(f"{args.output}/{name}.parquet")
        return 0
    except (ValueError, RuntimeError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
