"""Readers and writers of text and array formats for clouds, meshes, grids and poses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

NUMBER = r"[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?"


def _lines(spark: SparkSession, paths) -> DataFrame:
    """(path, mesh_id, k, line): the lines of whole files with their places."""
    t = spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value"))
    t = t.select("path", F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1).alias("mesh_id"), F.posexplode(F.split("value", "\r?\n")).alias("k", "line"))
    return t.withColumn("line", F.trim("line"))


def _numbered(df: DataFrame, name: str) -> DataFrame:
    """Place of each row among those of its file, from 0."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy("path").orderBy("k")) - 1)


def _xyz(words, first: int) -> list:
    return [F.get(words, F.lit(first + i)).cast("double").alias(c) for i, c in enumerate("xyz")]


def read_obj(spark: SparkSession, paths) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(vertices, faces, normals) of OBJ files. Indices become 0-based; ``a//n`` and ``a/t/n`` are accepted."""
    words = F.split("line", r"\s+")
    lines = _lines(spark, paths).withColumn("w", words)
    v = _numbered(lines.where("w[0] = 'v'"), "vid").select("mesh_id", F.col("vid").cast("long"), *_xyz(F.col("w"), 1))
    n = _numbered(lines.where("w[0] = 'vn'"), "vid").select("mesh_id", F.col("vid").cast("long"), *[c.alias(f"n{a}") for c, a in zip(_xyz(F.col("w"), 1), "xyz", strict=True)])
    at = [(F.split(F.get("w", F.lit(i)), "/")[0].cast("long") - 1).alias(k) for i, k in ((1, "a"), (2, "b"), (3, "c"))]
    f = _numbered(lines.where("w[0] = 'f'"), "fid").select("mesh_id", F.col("fid").cast("long"), *at)
    return v, f, n


def _write_lines(lines: DataFrame, path: str, key: str = "mesh_id") -> None:
    """Write (key, part, n, line), in that order, into one folder for each key."""
    lines.repartition(key).sortWithinPartitions(key, "part", "n").select(key, F.col("line").alias("value")).write.partitionBy(key).text(path)


def write_obj(vertices: DataFrame, faces: DataFrame, path: str, normals: DataFrame | None = None) -> None:
    v = vertices.select("mesh_id", F.lit(0).alias("part"), F.col("vid").alias("n"), F.format_string("v %f %f %f", "x", "y", "z").alias("line"))
    one = [F.col(k) + 1 for k in "abc"]
    face = F.format_string("f %d//%d %d//%d %d//%d", one[0], one[0], one[1], one[1], one[2], one[2]) if normals is not None else F.format_string("f %d %d %d", *one)
    out = v.union(faces.select("mesh_id", F.lit(2), F.col("fid"), face))
    if normals is not None:
        out = out.union(normals.select("mesh_id", F.lit(1), F.col("vid"), F.format_string("vn %f %f %f", "nx", "ny", "nz")))
    _write_lines(out, path)


def read_off(spark: SparkSession, paths) -> tuple[DataFrame, DataFrame]:
    """(vertices, faces) of OFF files; the counts may share the first line; a face that isn't a triangle is an error."""
    lines = _lines(spark, paths).where("line <> '' and not line like '#%'")
    lines = lines.withColumn("line", F.trim(F.regexp_replace("line", "^OFF", ""))).where("line <> ''")
    lines = _numbered(lines.withColumn("w", F.split("line", r"\s+")), "n")
    head = lines.where("n = 0").select("path", F.col("w")[0].cast("long").alias("nv"), F.col("w")[1].cast("long").alias("nf"))
    rows = lines.where("n > 0").join(head, "path")
    v = rows.where("n <= nv").select("mesh_id", (F.col("n") - 1).cast("long").alias("vid"), *_xyz(F.col("w"), 0))
    tri = F.when(F.col("w")[0] == "3", F.col("w")[1].cast("long")).otherwise(F.raise_error(F.lit("not a triangle")).cast("long"))
    f = rows.where("n > nv and n <= nv + nf").select("mesh_id", (F.col("n") - 1 - F.col("nv")).cast("long").alias("fid"), tri.alias("a"), F.col("w")[2].cast("long").alias("b"), F.col("w")[3].cast("long").alias("c"))
    return v, f


def read_sdf(spark: SparkSession, paths) -> tuple[DataFrame, DataFrame]:
    """(grid, header) of SDF text files: dimensions, origin, resolution, then values with i fastest, then j, then k.

    Files are read in splits; a value's place is the running number of values before it in its file.
    """
    from ..operators.rounds import running_within

    t = spark.read.text(paths).select("_metadata.file_path", F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("line"), F.filter(F.split(F.trim("value"), r"\s+"), lambda x: x != "").alias("w"))
    t = running_within(t.where(F.size("w") > 0), ["file_path"], [F.col("at"), F.col("line")], {"upto": F.size("w").cast("long")})
    t = t.select(F.col("file_path"), F.regexp_extract("file_path", r"([^/]+?)(?:\.[^./]*)?$", 1).alias("mesh_id"), (F.col("upto") - F.size("w")).alias("before"), F.posexplode("w").alias("p", "v"))
    t = t.select("file_path", "mesh_id", (F.col("before") + F.col("p") - 7).alias("p"), F.col("v").cast("double").alias("val"))
    names = {-7: "nx", -6: "ny", -5: "nz", -4: "ox", -3: "oy", -2: "oz", -1: "res"}
    head = t.where("p < 0").groupBy("file_path", "mesh_id").agg(*[F.max(F.when(F.col("p") == k, F.col("val"))).cast("int" if n[0] == "n" else "double").alias(n) for k, n in names.items()])
    vals = t.where("p >= 0").join(head.select("file_path", "nx", "ny"), "file_path")
    g = vals.select("mesh_id", (F.col("p") % F.col("nx")).cast("int").alias("i"), (F.floor(F.col("p") / F.col("nx")) % F.col("ny")).cast("int").alias("j"), F.floor(F.col("p") / (F.col("nx") * F.col("ny"))).cast("int").alias("k"), "val")
    return g, head.drop("file_path")


def read_sdf2d(spark: SparkSession, path: str) -> DataFrame:
    """(mesh_id, i, j, val) of a matrix of comma-separated numbers."""
    lines = _numbered(_lines(spark, path).where("line <> ''"), "i")
    return lines.select("mesh_id", "i", F.posexplode(F.split("line", r"\s*,\s*")).alias("j", "v")).select("mesh_id", "i", "j", F.col("v").cast("double").alias("val"))


def read_transforms(spark: SparkSession, path: str, order: str = "row") -> DataFrame:
    """(cloud_id, h): one rigid transform a line: key, nine rotation numbers, three of translation, and a 1.

    The file doesn't say whether the nine go by rows or columns: ``order``.
    """
    w = F.split("value", r"\s*,\s*")
    n = lambda i: w[i].cast("double")
    at = lambda r, c: 1 + (3 * r + c if order == "row" else 3 * c + r)
    rows = [x for r in range(3) for x in (*[n(at(r, c)) for c in range(3)], n(10 + r))]
    return spark.read.text(path).where("trim(value) <> ''").select(w[0].alias("cloud_id"), F.array(*rows, *[F.lit(x) for x in (0.0, 0.0, 0.0, 1.0)]).alias("h"))


def read_grippers(spark: SparkSession, path: str) -> DataFrame:
    """Parameters of grippers from <path>/<name>/params.json, with the gripper's name."""
    return spark.read.option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "params.json").json(path).withColumn("gripper", F.regexp_extract("_metadata.file_path", r"([^/]+)/params\.json$", 1))


def read_stp(spark: SparkSession, paths) -> DataFrame:
    """(mesh_id, pose_id, p, r, x0) of stable-pose files: blocks of p, three r lines and one x0 line."""
    t = spark.read.text(paths, wholetext=True).select(F.regexp_extract("_metadata.file_path", r"([^/]+?)(?:\.[^./]*)?$", 1).alias("mesh_id"), F.posexplode(F.regexp_extract_all("value", F.lit(r"(?s)(?:^|\n)\s*(p\s.*?)(?=\n\s*p\s|$)"), F.lit(1))).alias("pose_id", "b"))
    nums = lambda tag: F.transform(F.regexp_extract_all("b", F.lit(rf"(?m)^\s*{tag}\s+(.*)$"), F.lit(1)), lambda s: F.transform(F.split(F.trim(s), r"\s+"), lambda x: x.cast("double")))
    return t.select("mesh_id", "pose_id", F.flatten(nums("p"))[0].alias("p"), F.flatten(nums("r")).alias("r"), F.flatten(nums("x0")).alias("x0"))


def write_stp(poses: DataFrame, path: str, min_prob: float = 0.0) -> None:
    r = lambda i: F.format_string("r %f %f %f", *[F.col("r")[3 * i + c] for c in range(3)])
    lines = F.array(F.format_string("p %f", "p"), r(0), r(1), r(2), F.format_string("x0 %f %f %f", *[F.col("x0")[c] for c in range(3)]))
    out = poses.where(F.col("p") >= min_prob).select("mesh_id", F.col("pose_id").cast("int").alias("part"), F.posexplode(lines).alias("n", "line"))
    _write_lines(out.select("mesh_id", "part", F.col("n").cast("long").alias("n"), "line"), path)


def _cloud(points: DataFrame, path: str, head, colour: bool) -> None:
    n = points.groupBy("cloud_id").agg(F.count("*").alias("n"))
    row = F.format_string("%f %f %f %d", "x", "y", "z", F.shiftleft("r", 16) + F.shiftleft("g", 8) + F.col("b")) if colour == "packed" else F.format_string("%f %f %f %d %d %d", "x", "y", "z", "r", "g", "b") if colour else F.format_string("%f %f %f", "x", "y", "z")
    top = n.select("cloud_id", F.lit(0).alias("part"), F.posexplode(F.array(*head(F.col("n").cast("string")))).alias("n", "line")).select("cloud_id", "part", F.col("n").cast("long").alias("n"), "line")
    _write_lines(top.union(points.select("cloud_id", F.lit(1), F.col("point_id"), row)), path, "cloud_id")


def write_pcd(points: DataFrame, path: str, colour: bool = False) -> None:
    """ASCII PCD of each cloud: x y z, or with one packed colour number."""
    fields, size, kind, count = ("x y z rgb", "4 4 4 4", "F F F U", "1 1 1 1") if colour else ("x y z", "4 4 4", "F F F", "1 1 1")
    head = lambda n: [F.lit("# .PCD v0.7"), F.lit("VERSION 0.7"), F.lit(f"FIELDS {fields}"), F.lit(f"SIZE {size}"), F.lit(f"TYPE {kind}"), F.lit(f"COUNT {count}"), F.concat(F.lit("WIDTH "), n), F.lit("HEIGHT 1"), F.lit("VIEWPOINT 0 0 0 1 0 0 0"), F.concat(F.lit("POINTS "), n), F.lit("DATA ascii")]
    _cloud(points, path, head, "packed" if colour else False)


def write_ply(points: DataFrame, path: str, colour: bool = False) -> None:
    props = [F.lit(f"property float {c}") for c in "xyz"] + ([F.lit(f"property uchar {c}") for c in ("red", "green", "blue")] if colour else [])
    _cloud(points, path, lambda n: [F.lit("ply"), F.lit("format ascii 1.0"), F.concat(F.lit("element vertex "), n), *props, F.lit("end_header")], colour)


def write_ply_mesh(vertices: DataFrame, faces: DataFrame, path: str) -> None:
    """ASCII PLY of each mesh, with its triangles; vertices are written in order of vid, which faces count from 0."""
    n = vertices.groupBy("mesh_id").agg(F.count("*").cast("string").alias("n"))
    m = faces.groupBy("mesh_id").agg(F.count("*").cast("string").alias("m"))
    n = n.join(m, "mesh_id", "left").withColumn("m", F.coalesce("m", F.lit("0")))
    head = [F.lit("ply"), F.lit("format ascii 1.0"), F.concat(F.lit("element vertex "), "n"), *[F.lit(f"property float {c}") for c in "xyz"], F.concat(F.lit("element face "), "m"), F.lit("property list uchar int vertex_indices"), F.lit("end_header")]
    top = n.select("mesh_id", F.lit(0).alias("part"), F.posexplode(F.array(*head)).alias("n", "line")).select("mesh_id", "part", F.col("n").cast("long").alias("n"), "line")
    rows = vertices.select("mesh_id", F.lit(1), F.col("vid"), F.format_string("%f %f %f", "x", "y", "z")).union(faces.select("mesh_id", F.lit(2), F.col("fid"), F.format_string("3 %d %d %d", "a", "b", "c")))
    _write_lines(top.union(rows), path)


def read_ply(spark: SparkSession, paths) -> tuple[DataFrame, DataFrame]:
    """(vertices, faces) of ASCII PLY files: x, y, z from the first three properties; a face that isn't a triangle is an error."""
    lines = _numbered(_lines(spark, paths).where("line <> ''"), "n").withColumn("w", F.split("line", r"\s+"))
    count = lambda name: F.max(F.when((F.get("w", F.lit(0)) == "element") & (F.get("w", F.lit(1)) == name), F.get("w", F.lit(2)).cast("long")))
    head = lines.groupBy("path").agg(F.coalesce(count("vertex"), F.lit(0)).alias("nv"), F.coalesce(count("face"), F.lit(0)).alias("nf"), F.min(F.when(F.col("line") == "end_header", F.col("n"))).alias("top"))
    rows = lines.join(head, "path").withColumn("at", F.col("n") - F.col("top") - 1).where("at >= 0")
    v = rows.where("at < nv").select("mesh_id", F.col("at").cast("long").alias("vid"), *_xyz(F.col("w"), 0))
    tri = F.when(F.get("w", F.lit(0)) == "3", F.get("w", F.lit(1)).cast("long")).otherwise(F.raise_error(F.lit("not a triangle")).cast("long"))
    f = rows.where("at >= nv and at < nv + nf").select("mesh_id", (F.col("at") - F.col("nv")).cast("long").alias("fid"), tri.alias("a"), F.get("w", F.lit(2)).cast("long").alias("b"), F.get("w", F.lit(3)).cast("long").alias("c"))
    return v, f


def read_npy(spark: SparkSession, glob: str, columns: list[str]) -> DataFrame:
    """(path, row, columns...) of NPY arrays, by ranges of rows; see ``arrays.read_arrays``, which reads NPZ as well."""
    from .arrays import read_arrays

    return read_arrays(spark, glob, columns).drop("member")


def list_views(spark: SparkSession, path: str, pattern: str = r"([^/]+)/(NP\d)_(\d+)[^/]*$", suffix: str = "*") -> DataFrame:
    """(path, object, camera, angle) from the names of files; their content is not read."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", suffix).load(path).select("path")
    return f.select("path", *[F.regexp_extract("path", pattern, i).alias(n) for i, n in enumerate(("object", "camera", "angle"), 1)]).where("object <> ''")


def read_frames(spark: SparkSession, path: str, stream: bool = False, organised: bool = False) -> DataFrame:
    """Frames (frame_id, ts, source, and if organised height and width, points) with ``is_dense``: no coordinate is missing, NaN or infinite."""
    schema = "frame_id long, ts timestamp, source long, " + "height int, width int, " * organised + "points array<struct<x:double,y:double,z:double>>"
    reader = (spark.readStream if stream else spark.read).schema(schema).option("recursiveFileLookup", True)  # whatever folders a sink made
    t = reader.parquet(path)
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return t.withColumn("is_dense", F.forall("points", lambda p: fine(p["x"]) & fine(p["y"]) & fine(p["z"])))


def organised(pixels: DataFrame, height: int, width: int) -> DataFrame:
    """Frames with ``height``, ``width`` and all their places, row by row, from pixels (frame_id, ts, source, v, u, x, y, z); holes are null.

    Pixels out of bounds are left out; of several at a place, the least stays. Places are joined by frame and number, so a
    frame's array is put together from its own places alone.
    """
    frame = ["frame_id", "ts", "source"]
    p = pixels.where(f"v >= 0 and u >= 0 and v < {height} and u < {width}").groupBy(*frame, (F.col("v") * width + F.col("u")).cast("long").alias("at")).agg(F.min(F.struct("x", "y", "z")).alias("p"))
    places = pixels.select(*frame).distinct().withColumn("at", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(height * width - 1).cast("long"))))
    same = [places[c].eqNullSafe(p[c]) for c in (*frame, "at")]
    whole = places.join(p, same, "left").select(*[places[c] for c in (*frame, "at")], p["p"])
    whole = whole.groupBy(*frame).agg(F.array_sort(F.collect_list(F.struct("at", "p"))).alias("c"))
    return whole.select(*frame, F.lit(height).alias("height"), F.lit(width).alias("width"), F.transform("c", lambda x: x["p"]).alias("points"))


def pixels_of(frames: DataFrame) -> DataFrame:
    """The pixels (v, u, x, y, z) of organised frames; holes have none."""
    p = frames.select("frame_id", "ts", "source", "width", F.posexplode("points").alias("at", "p")).where("p is not null")
    return p.select("frame_id", "ts", "source", F.floor(F.col("at") / F.col("width")).cast("int").alias("v"), (F.col("at") % F.col("width")).cast("int").alias("u"), "p.*")


def write_frames_batch(frames: DataFrame, path: str, run: str, batch_id: int) -> None:
    """Write a micro-batch into a folder of its own; a batch that comes again takes the place of what it wrote before."""
    frames.write.mode("overwrite").parquet(f"{path}/run={run}/batch={batch_id}")


def write_frames(frames: DataFrame, path: str, checkpoint: str, run: str = "0"):
    """A stream writer of frames, organised or not. ``run`` names the stream: one with a new checkpoint needs a new name."""
    return frames.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda batch, n: write_frames_batch(batch, path, run, n))


def split_pieces(lines: DataFrame) -> DataFrame:
    """Lines (mesh_id, k, line) of an OBJ of several ``o`` pieces: each with its piece, and vertex numbers of the piece.

    A face's indices are turned to count from the piece's first vertex.
    """
    w = Window.partitionBy("mesh_id").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    t = lines.withColumn("w", F.split("line", r"\s+")).withColumn("piece", F.count_if(F.col("w")[0] == "o").over(w)).withColumn("seen", F.count_if(F.col("w")[0] == "v").over(w))
    first = t.where("w[0] = 'v'").groupBy("mesh_id", "piece").agg((F.min("seen") - 1).alias("before"))
    t = t.join(first, ["mesh_id", "piece"], "left")
    face = F.concat(F.lit("f "), F.array_join(F.transform(F.slice("w", F.lit(2), F.lit(3)), lambda x: (F.split(x, "/")[0].cast("long") - F.col("before")).cast("string")), " "))
    return t.select("mesh_id", "piece", "k", F.when(F.col("w")[0] == "f", face).otherwise(F.col("line")).alias("line"))


def write_preds(preds: DataFrame, path: str) -> None:
    preds.select("row_id", "label", "probs").write.parquet(path)


def read_preds(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("row_id long, label int, probs array<double>").parquet(path)
