"""python -m tessella encode FOLDER OUT: OBJ files to OUT/<name>.drc
python -m tessella transcode FOLDER OUT [loose]: glTF files, with the files they name, to OUT/files/<name>.glb (loose: .gltf, .bin and images) and OUT/report (JSON)
"""

import sys

from pyspark.sql import SparkSession


def main(args: list[str]) -> int:
    if len(args) not in (3, 4) or args[0] not in ("encode", "transcode") or args[3:] not in ([], ["loose"]):
        print(__doc__)
        return 2
    from tessella import export
    from tessella.shipping import ship

    spark = SparkSession.builder.getOrCreate()
    ship(spark)
    if args[0] == "encode":
        export.encode_folder(spark, args[1], args[2])
    else:
        export.transcode_folder(spark, args[1], args[2], loose=args[3:] == ["loose"])
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
