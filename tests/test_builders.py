"""Builders on made-up listings: what each path becomes."""

from pyspark.sql import functions as F

from scoreloom.operators import manifest
from scoreloom.sources import builders

PATHS = {
    "bangla_voices": [("S01F12/Real/a.wav", "bangla_voices/S01F12/real/a", "real"), ("x/S2M3/Fake/b.WAV", "bangla_voices/S2M3/fake/b", "fake"), ("S01F12/Other/a.wav", None, None), ("S01X12/Real/a.wav", None, None), ("S01F12/Real/a.mp3", None, None)],
    "banglafake": [("final_data/deepfake_data_mozilla/real_wav/c_s12_3.wav", "banglafake/mozilla/real/c_s12_3", "real"), ("final_data/deepfake_data_sust/deepfake_wav/1.wav", "banglafake/sust/fake/1", "fake"), ("final_data/data_x/real_wav/1.wav", None, None)],
    "bd_grf6": [("a/Femail Real/b/x.mp3", "bd_grf6/female_real/x", "real"), ("Third Gender Fake/Male Fake/x.wav", "bd_grf6/male_fake/x", "fake"), ("Female Odd/x.wav", None, None)],
    "indicsuperb": [("k/Hindi/test/audio/12-7-f.m4a", "indicsuperb/hindi/test/12", "real"), ("k/french/test/audio/12-7-f.m4a", None, None), ("k/hindi/test/clips/12-7-f.m4a", None, None)],
    "mavos_dd_hi": [("hindi/real/a.mp4", "mavos_dd_hi/real/a", "real"), ("hindi/knnvc/a.mp4", "mavos_dd_hi/knnvc/a", "fake"), ("hindi/freevc/a.mp4", None, None), ("german/real/a.mp4", None, None)],
    "mavos_dd_de": [("german/freevc/a.mp4", "mavos_dd_de/freevc/a", "fake")],
    "mendeley_roop_akool": [("z/deepfake/v_Tech-02_f1.JPG", "mendeley_roop_akool/deepfake/v_Tech-02_f1", "fake"), ("real/v.png", "mendeley_roop_akool/real/v", "real"), ("__MACOSX/real/v.png", None, None), ("real/._v.png", None, None)],
    "mlaad": [("fake/de/Bark/x.wav", "mlaad/de/Bark/x", "fake"), ("real/de/Bark/x.wav", None, None)],
    "speechfake": [("MD/EdgeTTS/hi/v1/x.wav", "speechfake/MD/EdgeTTS/hi/v1/x", "fake"), ("Real/CommonVoice/bn/x.wav", "speechfake/Real/CommonVoice/bn/x", "real"), ("CommonVoice/ta/x.wav", "speechfake/CommonVoice/ta/x", "real"), ("MD/EdgeTTS/fr/x.wav", None, None)],
    "unidatapro_videos": [("video/1.MOV", "unidatapro_videos/video/1", "real"), ("deepfake/1.mp4", "unidatapro_videos/deepfake/1", "fake"), ("other/1.mp4", None, None)],
    "urdu_csalt": [("Spoofed_TTS/sp 1/a b.wav", "urdu_csalt/Spoofed_TTS/sp_1/a_b", "fake"), ("Bonafide/sp1/a.wav", "urdu_csalt/Bonafide/sp1/a", "real"), ("Bonafide/a.wav", None, None)],
}


def listing(spark, paths):
    return spark.createDataFrame([(p,) for p in paths], "rel_path string")


def test_paths(spark):
    assert set(PATHS) == set(builders.PATH_BUILDERS)
    for name, cases in PATHS.items():
        out = builders.PATH_BUILDERS[name](listing(spark, [c[0] for c in cases])).cache()
        assert {r.rel_path: (r.item_id, r.label) for r in out.collect()} == {p: (i, y) for p, i, y in cases if i}, name
        assert manifest.problems(out, name).collect() == [], name


def test_attributes(spark):
    get = lambda name, path: builders.PATH_BUILDERS[name](listing(spark, [path])).first()
    assert get("bangla_voices", "S01F12/Real/a.wav").g_gender == "female"
    assert get("banglafake", "final_data/deepfake_data_mozilla/real_wav/c_s12_3.wav").subject_id == "mozilla_s12"
    r = get("mavos_dd_de", "german/inswapper/a.mp4")
    assert (r.label_video, r.label_audio, r.method_family) == ("fake", None, "face_swap")
    assert get("mendeley_roop_akool", "deepfake/v_Tech-02_f1.jpg").method == "tech_2"
    assert get("speechfake", "MD/EdgeTTS/hi/v1/x.wav").subject_id == "v1" and get("speechfake", "MD/SeedVC/hi/x.wav").method_family == "vc"


def test_metadata(spark):
    lines = spark.createDataFrame([("eval", "sp1 U1 - A07 spoof"), ("eval", "sp2 U2 - - bonafide"), ("eval", "short line"), ("dev", "sp3 U3 - - bonafide")], "split string, value string")
    out = builders.asvspoof2019_la(listing(spark, ["LA/ASVspoof2019_LA_eval/flac/U1.flac", "LA/ASVspoof2019_LA_eval/flac/U2.flac"]), lines)
    assert {(r.item_id, r.label, r.method, r.method_family, r.subject_id) for r in out.collect()} == {("asvspoof2019_la/eval/U1", "fake", "A07", "tts", "sp1"), ("asvspoof2019_la/eval/U2", "real", None, None, "sp2")}
    people = spark.createDataFrame([("7", "Vid", " East Asian", "F", None), ("9", "Img", "white", "M", "20")], "ID string, `Img/Vid` string, Race string, Gender string, Age string")
    out = {r.rel_path: r for r in builders.hidf(listing(spark, ["Real-vid/7.mp4", "Fake-vid/7_9.mp4"]), people).collect()}
    assert (out["Real-vid/7.mp4"].g_race, out["Real-vid/7.mp4"].g_age_src) == ("east_asian", None) and out["Fake-vid/7_9.mp4"].g_race == "white" and out["Fake-vid/7_9.mp4"].source_subject_id == "9"
    out = builders.celeb_df_v2(listing(spark, ["Celeb-real/a.mp4", "Celeb-synthesis/b.mp4"]), spark.createDataFrame([("1 Celeb-real/a.mp4",)], "value string"))
    assert {(r.item_id, r.split) for r in out.collect()} == {("celeb_df_v2/Celeb-real/a", "test"), ("celeb_df_v2/Celeb-synthesis/b", "train")}
    out = builders.in_the_wild(listing(spark, ["release_in_the_wild/1.wav"]), spark.createDataFrame([("1.wav", "Ann", "spoof"), ("2.wav", "Bob", "spoof")], "file string, speaker string, label string"))
    assert [(r.item_id, r.label, r.subject_id) for r in out.collect()] == [("in_the_wild/1", "fake", "Ann")]
    out = builders.openslr_sinhala(listing(spark, ["asr_sinhala/data/a/u1.flac", "other/u1.flac"]), spark.createDataFrame([('u1\tspk"1\ttext',)], "value string"))
    assert [(r.item_id, r.subject_id) for r in out.collect()] == [("openslr_sinhala/u1", 'spk"1')]


def test_stored_rows(spark):
    rows = spark.createDataFrame([("Hindi", "p0", 3, "vits", 7.0, float("nan"), "Male"), ("Hindi", "p0", 4, "freevc24", None, 2.0, "")], "folder string, shard string, source_row long, `Generative Model` string, `Target Speaker ID` double, `Source Speaker_ID` double, Gender string")
    out = {r.item_id: r for r in builders.indicsynth(rows, cap=1).collect()}
    a, b = out["indicsynth/Hindi/p0/3"], out["indicsynth/Hindi/p0/4"]
    assert (a.subject_id, a.source_subject_id, a.g_gender, a.sampled, a.language) == ("7", None, "male", True, "hi") and (b.source_subject_id, b.g_gender, b.method_family) == ("2", None, "vc")
    assert all(r.split == "sample" for r in out.values())  # one of each generator
    rows = spark.createDataFrame([("s", 0, "ab_f_1", 1, "Bodo"), ("s", 1, None, 0, "Hindi"), ("s", 2, "x_q", -1, "Hindi")], "shard string, source_row long, id string, is_tts int, language string")
    out = {r.item_id: r for r in builders.indictts_challenge(rows).collect()}
    assert set(out) == {"indictts_challenge/s/0", "indictts_challenge/s/1"} and out["indictts_challenge/s/0"].subject_id == "AB_F" and out["indictts_challenge/s/0"].language == "brx"
    assert builders.indictts_challenge(rows.withColumn("label", F.lit("clash"))).count() == 2
