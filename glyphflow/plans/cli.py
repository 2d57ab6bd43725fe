"""spark-submit entry: ``ocr -i IMAGES [-o FOLDER] [--engine tiled|two-phase] [--no-text] --model-dir DIR [--lang en] [--extra-chars CHARS]``."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from glyphflow.operators.ctc import mask_array
from glyphflow.plans.engine import EngineConfig, EngineType, create_engine
from glyphflow.plans.inference import OnnxLoader
from glyphflow.plans.progress import observed, progress_line, watched
from glyphflow.plans.sinks import check_outputs, output_folder, write_files
from glyphflow.sources.dictionaries import allowed_characters, character_dictionary
from glyphflow.sources.images import NoImages, list_images, read_images


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="glyphflow")
    ocr = out.add_subparsers(dest="command", required=True).add_parser("ocr", help="read the text of images")
    ocr.add_argument("-i", "--input", required=True, help="an image or a folder of images")
    ocr.add_argument("-o", "--output", default=None, help='folder for the results; "output" by default')
    ocr.add_argument("--engine", default=EngineType.TILED.value, choices=[e.value for e in EngineType])
    ocr.add_argument("--no-text", action="store_true", help="no labels")
    ocr.add_argument("--model-dir", required=True, help="detector.onnx, recogniser.onnx, classifier.onnx (may be missing), dictionary.txt, and {lang}.txt")
    ocr.add_argument("--extra-chars", default="", help="characters of the recogniser's classes behind the dictionary, such as a space")
    ocr.add_argument("--lang", default=None, choices=["en"], help="only characters of this language's file")
    return out


def main(argv: list[str] | None = None, loader=None) -> int:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("glyphflow").getOrCreate()
    try:
        files = list_images(spark, args.input)
    except NoImages as e:
        print(e, file=sys.stderr)
        return 1
    dictionary = character_dictionary(spark, f"{args.model_dir}/dictionary.txt")
    mask = None
    if args.lang:
        mask = tuple(mask_array(dictionary, {r["ch"] for r in allowed_characters(spark, f"{args.model_dir}/{args.lang}.txt").collect()}))
    engine = create_engine(args.engine, EngineConfig(loader or OnnxLoader(args.model_dir), tuple(dictionary), mask, tuple(args.extra_chars)))
    folder = output_folder(spark, args.input, args.output)
    check_outputs(files, folder, "path")
    results, totals = observed(engine.transform(read_images(spark, args.input), keep_pixels=True))

    def tasks(done: int, known: int) -> None:
        print(f"{done} of {known} tasks", file=sys.stderr)

    written = watched(spark, lambda: write_files(results, folder, not args.no_text, on_image=lambda i, n, path, texts: print(progress_line(i, n, path, texts))), tasks)
    print(f"{written} of {files.count()} images, {totals.get['texts']} texts, in {folder}")
    return 0


if __name__ == "__main__":
    sys.exit(main())
