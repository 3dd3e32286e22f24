"""Item tables from listings: for each known corpus layout, columns that read label, method, language, people and split off a
path, a metadata table or a stored row. All are projections and joins; files that don't belong to the corpus are dropped.

``files`` has one column, rel_path. Metadata come as tables: see each builder.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.manifest import OPTIONAL
from ..operators.sampling import mark

# --- fixed values: codes, folders and names of the layouts ---------------------------------------------------------
#: Kinds of the attacks of the ASVspoof 2019 logical access set, as its public description lists them.
ATTACK_FAMILIES = {
    "A01": "tts", "A02": "tts", "A03": "tts", "A04": "tts", "A05": "vc", "A06": "vc", "A07": "tts",
    "A08": "tts", "A09": "tts", "A10": "tts", "A11": "tts", "A12": "tts", "A13": "tts_vc", "A14": "tts_vc",
    "A15": "tts_vc", "A16": "tts", "A17": "vc", "A18": "vc", "A19": "vc",
}
INDIC = {"bengali": "bn", "gujarati": "gu", "hindi": "hi", "kannada": "kn", "malayalam": "ml", "marathi": "mr", "odia": "or", "punjabi": "pa", "sanskrit": "sa", "tamil": "ta", "telugu": "te", "urdu": "ur"}
CHALLENGE = {"assamese": "as", "bengali": "bn", "bodo": "brx", "dogri": "doi", "english": "en", "gujarati": "gu", "hindi": "hi", "kannada": "kn", "malayalam": "ml", "manipuri": "mni", "marathi": "mr", "nepali": "ne", "odia": "or", "sanskrit": "sa", "tamil": "ta", "telugu": "te"}
GENERATORS = {"xtts_v2": "tts", "vits": "tts", "freevc24": "vc"}
AV_METHODS = {  # method: video track, audio track, kind
    "real": ("real", "real", None), "knnvc": ("real", "fake", "vc"), "freevc": ("real", "fake", "vc"), "inswapper": ("fake", None, "face_swap"), "hififace": ("fake", None, "face_swap"),
    "roop": ("fake", None, "face_swap"), "echomimic": ("fake", None, "talking_head"), "sonic": ("fake", None, "talking_head"), "memo": ("fake", None, "talking_head"), "liveportrait": ("fake", None, "reenactment"),
}


class Parts:
    """A relative path's parts as columns."""

    def __init__(self, path: str = "rel_path") -> None:
        self.path = F.col(path)
        self.parts = F.split(self.path, "/")
        self.depth = F.size(self.parts)
        self.name = F.element_at(self.parts, -1)
        self.suffix = F.lower(F.regexp_extract(self.name, r"(?<=.)(\.[^.]+)$", 1))
        self.stem = F.regexp_replace(self.name, r"(?<=.)\.[^.]+$", "")
        self.bare = F.regexp_replace(self.path, r"(?<=[^/])\.[^./]+$", "")

    def at(self, i: int) -> Column:
        """Part i from the start (1 is the first) or, if negative, from the end; null beyond."""
        return F.try_element_at(self.parts, F.lit(i))


def lookup(table: dict, key: Column) -> Column:
    """The key's value, null for keys that aren't there."""
    return F.create_map(*(F.lit(x) for kv in table.items() for x in kv))[key]


def _items(rows: DataFrame, dataset: str, modality: str, label: Column, local: Column, **columns: Column) -> DataFrame:
    """Rows with a label as an item table."""
    named = {"item_id": F.concat(F.lit(f"{dataset}/"), local), "dataset": F.lit(dataset), "rel_path": F.col("rel_path"), "modality": F.lit(modality), "label": label}
    text = F.lit(None).cast("string")
    rest = {c: columns.pop(c, F.lit(None).cast("double") if c == "duration_s" else text) for c in OPTIONAL}
    groups = {k: v for name, c in columns.items() for k, v in ((f"g_{name}", c), (f"g_{name}_src", F.when(c.isNotNull(), "dataset")))}
    return rows.select(*(c.alias(k) for k, c in (named | rest | groups).items())).where("label is not null")


def _if_fake(label: Column, value: str) -> Column:
    return F.when(label == "fake", value)


# --- layouts read off paths -----------------------------------------------------------------------------------------
def bangla_voices(files: DataFrame) -> DataFrame:
    p = Parts()
    speaker = p.at(-3)
    sex = F.regexp_extract(speaker, r"^S\d+([FM])\d+$", 1)
    label = F.when((p.suffix == ".wav") & (sex != ""), lookup({"Real": "real", "Fake": "fake"}, p.at(-2)))
    return _items(files, "bangla_voices", "audio", label, F.concat_ws("/", speaker, label, p.stem), language=F.lit("bn"), subject_id=speaker, source_subject_id=speaker, gender=lookup({"F": "female", "M": "male"}, sex))


def banglafake(files: DataFrame) -> DataFrame:
    p = Parts()
    sub = F.regexp_extract(p.at(2), r"^deepfake_data_(.*)$", 1)
    fits = (p.depth == 4) & (p.at(1) == "final_data") & (p.suffix == ".wav") & p.at(2).startswith("deepfake_data_")
    label = F.when(fits, lookup({"real_wav": "real", "deepfake_wav": "fake"}, p.at(3)))
    voice = F.regexp_extract(p.name, r"_s(\d+)_", 1)
    speaker = F.when((sub == "mozilla") & (voice != ""), F.concat(F.lit("mozilla_s"), voice))
    return _items(files, "banglafake", "audio", label, F.concat_ws("/", sub, label, p.stem), method=_if_fake(label, "vits"), method_family=_if_fake(label, "tts"), language=F.lit("bn"), subject_id=speaker, source_subject_id=speaker, subcorpus=sub)


def bd_grf6(files: DataFrame) -> DataFrame:
    """The last folder named for a sex and a class decides."""
    p = Parts()
    form = r"^(Femail|Female|Male|Third Gender) (Real|Fake)$"
    folder = F.try_element_at(F.filter(F.slice(p.parts, 1, F.greatest(p.depth - 1, F.lit(0))), lambda x: x.rlike(form)), F.lit(-1))
    label = F.when(p.suffix.isin(".wav", ".mp3", ".flac", ".m4a", ".ogg"), F.lower(F.regexp_extract(folder, form, 2)))
    sex = lookup({"Femail": "female", "Female": "female", "Male": "male", "Third Gender": "third_gender"}, F.regexp_extract(folder, form, 1))
    return _items(files, "bd_grf6", "audio", label, F.concat(sex, F.lit("_"), label, F.lit("/"), p.stem), language=F.lit("bn"), gender=sex)


def celeb_df_v2(files: DataFrame, test_list: DataFrame) -> DataFrame:
    """``test_list(value)``: lines whose second field is a test video."""
    p = Parts()
    listed = test_list.select(F.try_element_at(F.split(F.trim("value"), r"\s+"), F.lit(2)).alias("rel_path")).distinct().withColumn("listed", F.lit(True))
    rows = files.join(listed, "rel_path", "left")
    label = F.when((p.depth == 2) & (p.suffix == ".mp4"), lookup({"Celeb-real": "real", "YouTube-real": "real", "Celeb-synthesis": "fake"}, p.at(1)))
    return _items(rows, "celeb_df_v2", "video", label, F.concat_ws("/", p.at(1), p.stem), method_family=_if_fake(label, "face_swap"), split=F.when(F.col("listed"), "test").otherwise("train"))


def indicsuperb(files: DataFrame) -> DataFrame:
    p = Parts()
    form = r"^(\d+)-(\d+)-([mf])$"
    language = F.lower(p.at(-4))
    fits = (p.suffix == ".m4a") & (p.at(-2) == "audio") & p.stem.rlike(form) & language.isin(*INDIC)
    utterance, speaker, sex = (F.regexp_extract(p.stem, form, i) for i in (1, 2, 3))
    return _items(files, "indicsuperb", "audio", F.when(fits, "real"), F.concat_ws("/", language, p.at(-3), utterance), language=lookup(INDIC, language), subject_id=speaker, split=p.at(-3), gender=lookup({"m": "male", "f": "female"}, sex))


def mavos_dd(files: DataFrame, dataset: str, folder: str, language: str, without: tuple[str, ...] = ()) -> DataFrame:
    p = Parts()
    method = p.at(2)
    known = [m for m in AV_METHODS if m not in without]
    fits = (p.depth == 3) & (p.at(1) == folder) & (p.suffix == ".mp4") & method.isin(*known)
    label = F.when(fits, F.when(method == "real", "real").otherwise("fake"))
    track = lambda i: lookup({m: v[i] for m, v in AV_METHODS.items() if v[i]}, method)
    return _items(files, dataset, "audio_video", label, F.concat_ws("/", method, p.stem), method=F.when(method != "real", method), method_family=track(2), language=F.lit(language), label_video=track(0), label_audio=track(1))


def mendeley_roop_akool(files: DataFrame) -> DataFrame:
    p = Parts()
    hidden = F.array_contains(p.parts, "__MACOSX") | p.name.startswith(".")
    label = F.when(~hidden & p.suffix.isin(".jpg", ".jpeg", ".png"), lookup({"real": "real", "deepfake": "fake"}, p.at(-2)))
    tool = F.regexp_extract(p.name, r"Tech-0*(\d+)(?!\d)", 1)
    return _items(files, "mendeley_roop_akool", "image", label, F.concat_ws("/", p.at(-2), p.stem), method=F.when((label == "fake") & (tool != ""), F.concat(F.lit("tech_"), tool)), method_family=_if_fake(label, "face_swap"))


def mlaad(files: DataFrame) -> DataFrame:
    p = Parts()
    label = F.when((p.depth == 4) & (p.at(1) == "fake") & (p.suffix == ".wav"), "fake")
    return _items(files, "mlaad", "audio", label, F.concat_ws("/", p.at(2), p.at(3), p.stem), method=F.lower(p.at(3)), method_family=F.lit("tts"), language=p.at(2))


def speechfake(files: DataFrame) -> DataFrame:
    p = Parts()
    spoken = lambda c: c.isin("hi", "bn", "ta", "mr", "ml")
    own = F.when(p.at(1) == "Real", F.slice(p.parts, 2, 99)).otherwise(p.parts)
    fake = (p.depth >= 4) & (p.at(1) == "MD") & spoken(p.at(3))
    real = (F.size(own) >= 3) & (F.try_element_at(own, F.lit(1)) == "CommonVoice") & spoken(F.try_element_at(own, F.lit(2)))
    label = F.when(p.suffix == ".wav", F.when(fake, "fake").when(real, "real"))
    model = _if_fake(label, "x").isNotNull()
    tool = F.when(model, p.at(2))
    voice = F.when((tool == "EdgeTTS") & (p.depth > 4), p.at(4))
    return _items(files, "speechfake", "audio", label, p.bare, method=tool, method_family=lookup({"EdgeTTS": "tts", "SeedVC": "vc"}, tool), language=F.when(model, p.at(3)).otherwise(F.try_element_at(own, F.lit(2))), subject_id=voice)


def unidatapro_videos(files: DataFrame) -> DataFrame:
    p = Parts()
    label = F.when((p.depth == 2) & p.suffix.isin(".mp4", ".mov"), lookup({"video": "real", "deepfake": "fake"}, p.at(1)))
    return _items(files, "unidatapro_videos", "audio_video", label, F.concat_ws("/", p.at(1), p.stem), method_family=_if_fake(label, "face_swap"), label_video=label, label_audio=F.when(label == "real", "real"))


def urdu_csalt(files: DataFrame) -> DataFrame:
    p = Parts()
    top, fits = p.at(1), (p.depth >= 3) & (p.suffix == ".wav")
    label = F.when(fits, lookup({"Bonafide": "real", "Spoofed_TTS": "fake", "Spoofed_Tacotron": "fake"}, top))
    return _items(files, "urdu_csalt", "audio", label, F.replace(p.bare, F.lit(" "), F.lit("_")), method=lookup({"Spoofed_TTS": "vits", "Spoofed_Tacotron": "tacotron"}, top), method_family=_if_fake(label, "tts"), language=F.lit("ur"), subject_id=p.at(2), source_subject_id=p.at(2))


# --- layouts with metadata tables -------------------------------------------------------------------------------------
def asvspoof2019_la(files: DataFrame, protocols: DataFrame) -> DataFrame:
    """``protocols(split, value)``: lines of speaker, clip, system, attack, key; others are skipped."""
    f = F.split(F.trim("value"), r"\s+")
    clip = F.concat(F.lit("LA/ASVspoof2019_LA_"), F.col("split"), F.lit("/flac/"), f[1], F.lit(".flac"))
    rows = protocols.where(F.size(f) == 5).select(clip.alias("rel_path"), "split", f[0].alias("speaker"), F.nullif(f[3], F.lit("-")).alias("attack"), f[4].alias("key")).join(files, "rel_path", "left_semi")
    return _items(rows, "asvspoof2019_la", "audio", lookup({"bonafide": "real", "spoof": "fake"}, F.col("key")), F.concat_ws("/", "split", Parts().stem), method=F.col("attack"), method_family=lookup(ATTACK_FAMILIES, F.col("attack")), language=F.lit("en"), subject_id=F.col("speaker"), split=F.col("split"))


def hidf(files: DataFrame, people: DataFrame) -> DataFrame:
    """``people(ID, Img/Vid, Race, Gender, Age)``, all strings. A fake shows the face's person, a real the video's."""
    p = Parts()
    label = F.when(p.suffix == ".mp4", lookup({"Real-vid": "real", "Fake-vid": "fake"}, p.at(-2)))
    base, face = F.substring_index(p.stem, "_", 1), F.nullif(F.regexp_extract(p.stem, r"^[^_]*_(.*)$", 1), F.lit(""))
    clean = lambda c: F.nullif(F.replace(F.lower(F.trim(c)), F.lit(" "), F.lit("_")), F.lit(""))
    who = people.select(F.trim("ID").alias("who"), F.trim("`Img/Vid`").alias("kind"), *(clean(c).alias(c.lower()) for c in ("Race", "Gender", "Age"))).dropDuplicates(["who", "kind"])
    rows = files.withColumns({"kind": F.when(label == "fake", "Img").otherwise("Vid"), "who": F.when(label == "fake", face).otherwise(base)}).join(who, ["kind", "who"], "left")
    return _items(rows, "hidf", "video", label, F.concat_ws("/", label, p.stem), method_family=_if_fake(label, "face_swap"), subject_id=base, source_subject_id=face, race=F.col("race"), gender=F.col("gender"), age=F.col("age"))


def in_the_wild(files: DataFrame, meta: DataFrame) -> DataFrame:
    """``meta(file, speaker, label)``."""
    rows = meta.withColumnRenamed("label", "key").withColumn("rel_path", F.concat(F.lit("release_in_the_wild/"), "file")).join(files, "rel_path", "left_semi")
    return _items(rows, "in_the_wild", "audio", lookup({"bona-fide": "real", "spoof": "fake"}, F.col("key")), Parts().stem, language=F.lit("en"), subject_id=F.col("speaker"))


def openslr_sinhala(files: DataFrame, speakers: DataFrame) -> DataFrame:
    """``speakers(value)``: tab-separated clip and speaker, quotes being text."""
    f = F.split("value", "\t")
    who = speakers.where(F.size(f) >= 2).select(f[0].alias("clip"), f[1].alias("speaker")).dropDuplicates(["clip"])
    p = Parts()
    label = F.when((p.at(1) == "asr_sinhala") & (p.at(2) == "data") & (p.suffix == ".flac"), "real")
    rows = files.withColumn("clip", p.stem).join(who, "clip", "left")
    return _items(rows, "openslr_sinhala", "audio", label, p.stem, language=F.lit("si"), subject_id=F.col("speaker"))


# --- layouts of stored rows -------------------------------------------------------------------------------------------
def indicsynth(rows: DataFrame, cap: int = 5000) -> DataFrame:
    """``rows(folder, shard, source_row, Generative Model, Target Speaker ID, Source Speaker_ID, Gender)``, all fakes; the
    first ``cap`` of each language and generator by hash are marked, and their split is "sample"."""
    number = lambda c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double").cast("long").cast("string"))
    method = F.col("`Generative Model`")
    rows = rows.withColumn("rel_path", F.format_string("%s/wav/%s-%06d", "folder", "shard", "source_row"))
    out = _items(rows, "indicsynth", "audio", F.lit("fake"), F.concat_ws("/", "folder", "shard", F.col("source_row").cast("string")), method=method, method_family=lookup(GENERATORS, method), language=lookup(INDIC, F.lower("folder")), subject_id=number("`Target Speaker ID`"), source_subject_id=number("`Source Speaker_ID`"), split=F.lit("train"), gender=F.nullif(F.lower("Gender"), F.lit("")))
    out = mark(out, cap, ["language", "method"])
    return out.withColumn("split", F.when(F.col("sampled"), "sample").otherwise(F.col("split")))


def indictts_challenge(rows: DataFrame) -> DataFrame:
    """``rows(shard, source_row, id, is_tts, language)``; is_tts is 1, 0, or -1 for rows without a label."""
    label = F.when(F.col("is_tts") == 1, "fake").when(F.col("is_tts") == 0, "real")
    code = F.split(F.upper(F.coalesce("id", F.lit(""))), "_")
    sex = lookup({"F": "female", "M": "male"}, F.try_element_at(code, F.lit(2)))
    who = F.when((code[0] != "") & sex.isNotNull(), F.concat(code[0], F.lit("_"), F.try_element_at(code, F.lit(2))))
    rows = rows.withColumn("rel_path", F.format_string("wav/%s-%06d", "shard", "source_row"))
    return _items(rows, "indictts_challenge", "audio", label, F.concat_ws("/", "shard", F.col("source_row").cast("string")), method_family=_if_fake(label, "tts"), language=lookup(CHALLENGE, F.lower("language")), subject_id=who, split=F.lit("train"), gender=sex)


#: Builders that need nothing but the listing.
PATH_BUILDERS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "bangla_voices": bangla_voices,
    "banglafake": banglafake,
    "bd_grf6": bd_grf6,
    "indicsuperb": indicsuperb,
    "mavos_dd_hi": lambda f: mavos_dd(f, "mavos_dd_hi", "hindi", "hi", ("freevc",)),
    "mavos_dd_de": lambda f: mavos_dd(f, "mavos_dd_de", "german", "de"),
    "mendeley_roop_akool": mendeley_roop_akool,
    "mlaad": mlaad,
    "speechfake": speechfake,
    "unidatapro_videos": unidatapro_videos,
    "urdu_csalt": urdu_csalt,
}
