"""Command line: run, validate, export and serve; exit codes 0 ok, 2 input, 3 validation, 4 internal, 130 cancelled."""

import argparse
import json
import sys
from dataclasses import fields
from pathlib import Path

from massif import __version__, api
from massif.config import EngineConfig, InputError, ValidationError
from massif.functions.scalar import names_of
from massif.sources.exports import FORMATS


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="massif")
    p.add_argument("--version", action="version", version=__version__)
    sub = p.add_subparsers(dest="command", required=True)
    run = sub.add_parser("run", help="parts or trees from footprints and rasters")
    run.add_argument("--footprints", help="polygons with ids")
    run.add_argument("--dsm", help="surface, GeoTIFF")
    run.add_argument("--dtm", help="terrain, GeoTIFF")
    run.add_argument("--pixels", help="Parquet rows (object_id, row, col, dsm, dtm) in their place")
    run.add_argument("--output", required=True)
    run.add_argument("--params", help="a JSON object of parameters; flags override it")
    run.add_argument("--cancel-file", help="the run stops at its next step once this file is there")
    run.add_argument("--export", default="", help=f"of {', '.join(FORMATS)}, with commas")
    for f in fields(EngineConfig):
        kind = {int: int, float: float, bool: lambda x: x.lower() in ("1", "true", "yes")}.get(f.type, str)
        run.add_argument("--" + f.name.replace("_", "-"), type=kind, dest=f"p_{f.name}")
    sub.add_parser("validate", help="check a saved collection").add_argument("source")
    out = sub.add_parser("export", help="write a saved collection in other formats")
    out.add_argument("source")
    out.add_argument("--formats", required=True)
    serve = sub.add_parser("serve", help="jobs over HTTP on this machine")
    serve.add_argument("--host", default="127.0.0.1")
    serve.add_argument("--port", type=int, default=8000)
    serve.add_argument("--work-dir", required=True, type=Path)
    serve.add_argument("--max-upload-mb", type=int, default=1024)
    serve.add_argument("--max-concurrent", type=int, default=1)
    serve.add_argument("--ttl-hours", type=float, default=24.0)
    serve.add_argument("--grace-seconds", type=float, default=30.0)
    serve.add_argument("--cors-origin")
    return p


def parameters(args: argparse.Namespace) -> dict:
    """The JSON object's parameters under those of the flags."""
    given = {}
    if args.params:
        try:
            with open(args.params, encoding="utf-8") as f:
                given = json.load(f)
        except (OSError, ValueError) as e:
            raise InputError(f"{args.params}: {e}") from e
        if not isinstance(given, dict):
            raise InputError(f"{args.params} must hold an object")
    flags = {k[2:]: v for k, v in vars(args).items() if k.startswith("p_") and v is not None}
    given |= flags
    for name in ("keep_properties", "raster_drivers"):
        if isinstance(given.get(name), str):
            given[name] = names_of(given[name])
        if isinstance(given.get(name), list):
            given[name] = tuple(given[name])
    return given


def main(argv: list[str] | None = None, spark=None) -> int:
    args = parser().parse_args(argv)
    emit = lambda event, **more: print(json.dumps({"event": event, **more}), flush=True)
    try:
        if args.command == "serve":
            from massif.server import Settings, make_server

            server = make_server(Settings(args.work_dir, args.max_upload_mb, args.max_concurrent, args.ttl_hours, args.grace_seconds, args.cors_origin), args.host, args.port)
            emit("log", message=f"http://{args.host}:{server.server_port}")
            try:
                server.serve_forever()
            finally:
                server.manager.close()
            return 0
        formats = names_of(getattr(args, "export", "") or getattr(args, "formats", ""))
        unknown = sorted(set(formats) - set(FORMATS))
        if unknown:
            raise InputError(f"unknown formats: {', '.join(unknown)}")
        given = parameters(args) if args.command == "run" else {}
        if formats and given.get("mode") == "tree":
            raise InputError("trees can't be exported")
        if spark is None:
            from pyspark.sql import SparkSession

            spark = SparkSession.builder.appName("massif").getOrCreate()
        if args.command == "run":
            tell = lambda done, total, message: emit("progress", current=done, total=total, message=message)
            stop = (lambda: Path(args.cancel_file).exists()) if args.cancel_file else None
            result = api.run_elevation(spark, args.output, args.footprints, args.dsm, args.dtm, pixels=args.pixels, log=lambda m: emit("log", message=m), progress=tell, cancel=stop, **given)
            if result["cancelled"]:
                emit("error", kind="cancelled", message="cancelled")
                return 130
            if formats:
                result["export"] = api.export_file(spark, args.output, formats, given.get("working_crs", "EPSG:32750"))
        elif args.command == "validate":
            result = {"num_features": api.validate_file(spark, args.source)}
        else:
            result = api.export_file(spark, args.source, formats)
        emit("result", **result)
        return 0
    except InputError as e:
        emit("error", kind="input", message=str(e))
        return 2
    except ValidationError as e:
        emit("error", kind="validation", message=str(e))
        return 3
    except KeyboardInterrupt:
        emit("error", kind="cancelled", message="cancelled")
        return 130
    except Exception as e:  # noqa: BLE001
        emit("error", kind="internal", message=f"{type(e).__name__}: {e}")
        return 4


if __name__ == "__main__":
    sys.exit(main())
