"""Readers of annotation, phrase and reply files. Schemas are given, since inference reads everything twice and makes a
lone child a struct."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from groundphrase.operators.matching import described_boxes, samples
from groundphrase.operators.selection import expr_type
from groundphrase.sources.sections import block_states, read_section

COCO = """images array<struct<id:bigint,file_name:string,width:int,height:int>>,
annotations array<struct<id:bigint,image_id:bigint,category_id:int,category_name:string,bbox:array<double>,area:double,iscrowd:int,segmentation:array<array<double>>>>"""
ANNOTATION = """filename string, width int, height int,
object array<struct<id:bigint,name:string,bndbox:struct<xmin:int,ymin:int,xmax:int,ymax:int>,is_cutoff:boolean>>"""
_SAID = "struct<expression:array<struct<_VALUE:string,_id:string,_type:string>>>"
#: A patch's document after all rules: what is missing in a file is null.
FULL = f"""filename string, width int, height int, object array<struct<id:bigint,name:string,
bndbox:struct<xmin:int,ymin:int,xmax:int,ymax:int>,is_cutoff:boolean,grid_position:string,extreme_position:string,
size_attribute:string,color:string,is_ambiguous:boolean,possible_colors:string,
relationships:struct<relationship:array<struct<target_id:bigint,target_category:string,direction:string,distance:double,
is_cutoff:boolean,is_borderline:boolean,possible_directions:string>>>,segmentation:string,expressions:{_SAID},dummy_expression_ids:string>>,
groups array<struct<`group`:array<struct<id:bigint,instance_ids:string,size:int,category:string,grid_position:string,
centroid:struct<x:double,y:double>,segmentation:string,expressions:{_SAID},dummy_expression_ids:string>>,
relationships:struct<relationship:array<struct<source_id:bigint,target_id:bigint,direction:string,distance:double>>>>>"""
REFS = "refs array<struct<ref_id:bigint,ann_id:bigint,image_id:bigint,split:string,sentences:array<struct<sent:string>>>>"


def explode_coco(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(images, annotations) of parsed COCO documents."""
    a = docs.select(F.explode("annotations").alias("a")).select("a.*")
    return docs.select(F.explode("images").alias("i")).select("i.*"), _cornered(a)


def _cornered(annotations: DataFrame) -> DataFrame:
    box = F.col("bbox")
    return annotations.withColumns({"xmin": box[0], "ymin": box[1], "xmax": box[0] + box[2], "ymax": box[1] + box[3]})


def read_coco(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """COCO instance files. One file is one row and one task; read_coco_blocks() reads large files."""
    return explode_coco(spark.read.schema(COCO).json(path, multiLine=True))


def read_coco_blocks(spark: SparkSession, path: str | list[str]) -> tuple[DataFrame, DataFrame]:
    """read_coco() of files of any size, each split at any byte, see read_section(). Several documents may follow each other."""

    states = block_states(spark, path)

    def parsed(section: str) -> DataFrame:
        kind = StructType.fromDDL(COCO)[section].dataType.elementType
        return read_section(spark, path, section, states).select(F.from_json("value", kind).alias("x")).select("x.*")

    return parsed("images"), _cornered(parsed("annotations"))


def explode_annotations(docs: DataFrame) -> DataFrame:
    """(filename, object_id, category, box, is_cutoff), one row per object."""
    d = docs.select("filename", F.explode("object").alias("o"))
    return d.select("filename", F.col("o.id").alias("object_id"), F.col("o.name").alias("category"), "o.bndbox.*", "o.is_cutoff")


def _listed(text: Column, kind: str = "string") -> Column:
    """A comma list as an array; null for no list."""
    return F.split(text, r"\s*,\s*").cast(f"array<{kind}>")


def _expressions(df: DataFrame, kind: str, of: Column) -> DataFrame:
    """Expressions of targets; dummy ones are those whose place in the list is among dummy_expression_ids."""
    dummies = F.coalesce(_listed(of["dummy_expression_ids"], "int"), F.array().cast("array<int>"))
    d = df.select("filename", F.lit(kind).alias("target_kind"), of["id"].alias("target_id"), dummies.alias("d"), F.posexplode(of["expressions"]["expression"]).alias("pos", "e"))
    return d.select("filename", "target_kind", "target_id", "pos", expr_type("e._type", "e._id").alias("expr_type"), F.col("e._VALUE").alias("text"),
                    F.array_contains("d", F.col("pos")).alias("is_dummy"))


def read_annotations(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of annotation XML, see explode_documents()."""
    return explode_documents(spark.read.option("rowTag", "annotation").schema(FULL).xml(path))


def explode_documents(docs: DataFrame) -> dict[str, DataFrame]:
    """patches, objects, relations, groups, group_relations and expressions of documents of the schema FULL.

    Of several group lists of a patch the first counts. Relations have one row as they are written; expressions have
    their place in the list as pos, and their type from their attributes. mask is the text of a segmentation."""
    o = docs.select("filename", F.explode("object").alias("o"))
    objects = o.select(
        "filename", F.col("o.id").alias("object_id"), F.col("o.name").alias("category"), "o.bndbox.*", "o.is_cutoff", "o.grid_position",
        "o.extreme_position", "o.size_attribute", F.col("o.color").alias("colour"), "o.is_ambiguous", _listed(F.col("o.possible_colors")).alias("possible_colours"),
        F.col("o.segmentation").alias("mask"),
    )
    relations = o.select("filename", F.col("o.id").alias("object_id"), F.explode("o.relationships.relationship").alias("r")).select(
        "filename", "object_id", "r.target_id", "r.target_category", "r.direction", "r.distance", F.col("r.is_cutoff").alias("target_cutoff"),
        "r.is_borderline", _listed(F.col("r.possible_directions")).alias("possible_directions"),
    )
    first = docs.select("filename", F.try_element_at("groups", F.lit(1)).alias("f"))
    g = first.select("filename", F.explode("f.group").alias("g"))
    groups = g.select("filename", F.col("g.id").alias("group_id"), "g.category", "g.size", "g.grid_position", "g.centroid",
                      _listed(F.col("g.instance_ids"), "bigint").alias("instance_ids"), F.col("g.segmentation").alias("mask"))
    between = first.select("filename", F.explode("f.relationships.relationship").alias("r")).select("filename", "r.*")
    said = _expressions(o, "individual", F.col("o")).unionByName(_expressions(g, "group", F.col("g")))
    return {"patches": docs.select("filename", "width", "height"), "objects": objects, "relations": relations, "groups": groups,
            "group_relations": between, "expressions": said}


def read_samples(spark: SparkSession, path: str, split: str) -> DataFrame:
    """One row per target and phrase of annotation XML, with the target's class, box and mask; a group's box is that of its
    members."""
    a = read_annotations(spark, path)
    return samples(a["expressions"], a["objects"], a["groups"], "filename").withColumn("split", F.lit(split))


#: A patch's document with a description of each box, and the annotations whose boxes (corners) are looked up in it.
DESCRIBED = "split string, object array<struct<bndbox:struct<xmin:int,ymin:int,xmax:int,ymax:int>,description:string>>"
MASKED = "annotations array<struct<image_id:bigint,bbox:array<int>,segmentation:array<string>>>"


def read_box_descriptions(spark: SparkSession, xml: str, json: str, split: str, fallback: str = "the object in the image") -> DataFrame:
    """(image_id, bbox, segmentation, description) of a split: the annotations of a JSON file, described by the XML file whose
    name is their image's number, see described_boxes()."""
    docs = spark.read.option("rowTag", "annotation").schema(DESCRIBED).xml(xml)
    number = F.regexp_extract(F.col("_metadata.file_name"), r"^(\d+)\.xml$", 1).try_cast("bigint")
    annotations = spark.read.schema(MASKED).json(json, multiLine=True)
    return described_boxes(docs.select(number.alias("image_id"), "split", "object"), annotations, split, fallback)


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """Pictures as BGR bytes; files that can't be decoded are passed over."""
    return spark.read.format("image").option("dropInvalid", True).option("recursiveFileLookup", True).load(path).select("image.*")


def landcover_path(path: Column) -> list[Column]:
    """split, domain, kind and id in .../split/domain/images_png|masks_png/id.png"""
    pattern = r"([^/]+)/([^/]+)/(images|masks)[^/]*/([^/]+)\.png$"
    return [F.regexp_extract(path, pattern, i).alias(n) for i, n in enumerate(("split", "domain", "kind", "id"), 1)]


def read_landcover(spark: SparkSession, root: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.png").option("recursiveFileLookup", True).load(root)
    return files.select(*landcover_path(F.col("path")), "content")


def read_landcover_masks(spark: SparkSession, root: str) -> DataFrame:
    """(split, domain, image_id, width, height, data): decoded class masks, a byte a pixel; image_id is split/domain/id.

    Pictures of more than one channel, and files that can't be decoded, are passed over. blocks.to_blocks(masks, 1) and
    blocks.class_runs() lead on to runs of classes."""
    d = read_images(spark, root).filter("nChannels = 1").select(*landcover_path(F.col("origin")), "width", "height", "data")
    return d.filter("kind = 'masks'").select("split", "domain", F.concat_ws("/", "split", "domain", "id").alias("image_id"), "width", "height", "data")


def phrase_lines(lines: DataFrame) -> DataFrame:
    """(image_id, phrase) of lines "<image_id> <phrase>"; lines without a number and a phrase are passed over."""
    cut = F.split("value", " ", 2)
    d = lines.select(F.try_element_at(cut, F.lit(1)).try_cast("bigint").alias("image_id"), F.trim(F.try_element_at(cut, F.lit(2))).alias("phrase"))
    return d.filter("image_id is not null and phrase <> ''")


def read_phrase_list(spark: SparkSession, path: str, split: str) -> DataFrame:
    return phrase_lines(spark.read.text(path)).withColumn("split", F.lit(split))


def explode_refs(docs: DataFrame) -> DataFrame:
    """(ref_id, ann_id, image_id, split, n, sentence), one row per sentence."""
    d = docs.select(F.explode("refs").alias("r")).select("r.*")
    return d.select("ref_id", "ann_id", "image_id", "split", F.posexplode("sentences.sent").alias("n", "sentence"))


def read_refs(spark: SparkSession, path: str) -> DataFrame:
    return explode_refs(spark.read.schema(REFS).json(path, multiLine=True))


def split_lines(lines: DataFrame, path: Column) -> DataFrame:
    """(name, split) of lists labelled_{split}.txt; a .png ending is cut off, blank lines are passed over."""
    name = F.regexp_replace(F.trim("value"), r"\.png$", "")
    return lines.select(name.alias("name"), F.regexp_extract(path, r"labelled_([^/.]+)\.txt", 1).alias("split")).filter("name <> ''")


def read_split_lists(spark: SparkSession, root: str) -> DataFrame:
    return split_lines(spark.read.text(f"{root}/labelled_*.txt").withColumn("_f", F.input_file_name()), F.col("_f"))


BANK = "domain string, rgb_mean array<double>, rgb_std array<double>, num_images bigint"


def read_style_bank(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(BANK).json(path)


def write_style_bank(bank: DataFrame, path: str) -> None:
    bank.coalesce(1).write.json(path)


def read_llm_results(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(parsed, rejects) of reply lines."""
    from groundphrase.operators.enrichment import split_replies

    return split_replies(spark.read.text(path), "value", schema)


def read_result_dir(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A folder of JSON files, one result each, with the file's name."""
    return spark.read.schema(schema).json(path, multiLine=True).withColumn("file", F.col("_metadata.file_name"))


def metric_lines(texts: DataFrame, run: Column) -> DataFrame:
    """(run, lines): the first five lines of a metrics text that are not blank."""
    lines = F.filter(F.split("value", "\n"), lambda x: F.trim(x) != "")
    return texts.select(run.alias("run"), F.slice(lines, 1, 5).alias("lines"))


def read_run_metrics(spark: SparkSession, glob: str) -> DataFrame:
    texts = spark.read.text(glob, wholetext=True).withColumn("_f", F.input_file_name())
    return metric_lines(texts, F.regexp_extract("_f", r"([^/]+)/[^/]+$", 1))
