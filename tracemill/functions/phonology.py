"""The scalars of an utterance, from its feature map and its aligned phones, and their 17 traits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Classes of phones.
MONOPHTHONGS = ("a", "aː", "e", "eː", "i", "iː", "o", "oː", "u", "uː", "æ", "ɐ", "ɑ", "ɑː", "ɒ", "ɒː", "ɔ", "ə", "ɚ", "ɛ", "ɛː", "ɜ", "ɜː", "ɝ", "ɪ", "ʉ", "ʉː", "ʊ")
DIPHTHONGS = ("aj", "aw", "ej", "ow", "ɔj", "əw")
RHOTICS = ("ɹ", "ɚ", "ɝ", "ɾ")
SYLLABIC = ("m̩",)
SILENCES = ("", "SIL", "sil", "sp", "spn", "<eps>")

LMH = ("low", "mid", "high")
#: Each trait with its scalar and its labels up to the lower quantile, up to the upper one, and above.
ACOUSTIC = {
    "f0_level": ("f0_mean", LMH),
    "f0_var": ("f0_std", LMH),
    "f0_skew": ("f0_skew_proxy", LMH),
    "energy_level": ("energy_mean", LMH),
    "energy_var": ("energy_var_proxy", LMH),
    "snr_proxy": ("snr_proxy", LMH),
    "voice_stability": ("jitter", ("stable", "mid", "unstable")),
    "breathiness_proxy": ("shimmer", ("clear", "mid", "breathy")),
    "vowel_space_scale": ("vowel_space_scale", ("small", "mid", "large")),
    "front_back_tilt": ("front_back_tilt", ("front", "neutral", "back")),
}
PHONOLOGY = {
    "speaking_rate": ("articulation_rate", ("slow", "mid", "fast")),
    "mean_phone_dur": ("mean_phone_dur", ("short", "mid", "long")),
    "pause_frequency": ("pause_rate", ("rare", "mid", "frequent")),
    "vowel_ratio": ("vowel_ratio", LMH),
    "rhotic_phone_ratio": ("rhotic_ratio", LMH),
    "diphthong_index": ("diphthong_ratio", LMH),
}
SCALARS = (*(s for s, _ in ACOUSTIC.values()), *(s for s, _ in PHONOLOGY.values()), "has_syllabic")
GROUPS = {"acoustic": [*ACOUSTIC], "phonology": [*PHONOLOGY, "syllabic_consonants"]}


def ratio(a: Column, b: Column) -> Column:
    """a / b, and 0 unless b is positive."""
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def safe_log(x: Column) -> Column:
    return F.when(x > 1e-6, F.log(x)).otherwise(F.lit(0.0))


def unstressed(phone: Column) -> Column:
    """A phone without the digits that mark stress."""
    return F.translate(phone, "0123456789", "")


def acoustic_scalars(features: Column) -> dict[str, Column]:
    """By name the scalars of a map of features; what it lacks is 0."""
    get = lambda k: F.coalesce(F.try_element_at(features, F.lit(k)), F.lit(0.0))
    f1, f2 = get("F1_mean"), get("F2_mean")
    return {
        "f0_mean": get("pitch_mean"),
        "f0_std": get("pitch_std"),
        "f0_skew_proxy": get("pitch_mean") - get("pitch_median"),
        "energy_mean": get("energy_mean"),
        "energy_var_proxy": F.when(get("energy_dynamic_range") > 0, get("energy_dynamic_range")).otherwise(get("energy_max") - get("energy_min")),
        "snr_proxy": get("hnr_mean"),
        "jitter": get("jitter_local"),
        "shimmer": get("shimmer_local"),
        "vowel_space_scale": F.when((f1 > 0) & (f2 > 0), safe_log(f2) - safe_log(f1)).otherwise(F.lit(0.0)),
        "front_back_tilt": f2,
    }


def phone_scalars(phones: Column) -> dict[str, Column]:
    """By name the scalars of an array of (phoneme, duration): rates and shares by class. Silences count as pauses only; a phone
    of digits alone is one."""
    bare = F.transform(F.coalesce(phones, F.array().cast("array<struct<phoneme:string,duration:double>>")), lambda p: F.struct(unstressed(F.coalesce(p["phoneme"], F.lit(""))).alias("phoneme"), F.coalesce(p["duration"], F.lit(0.0)).alias("duration")))
    silent = lambda p: p["phoneme"].isin(*SILENCES)
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, p: s + p["duration"])
    spoken, pauses = F.filter(bare, lambda p: ~silent(p)), F.filter(bare, silent)
    of = lambda *names: F.size(F.filter(spoken, lambda p: p["phoneme"].isin(*names)))
    n, spoken_s = F.size(spoken), total(spoken)
    vowels = of(*MONOPHTHONGS, *DIPHTHONGS)
    return {
        "articulation_rate": ratio(n, spoken_s),
        "mean_phone_dur": ratio(spoken_s, n),
        "pause_rate": ratio(F.size(pauses), spoken_s + total(pauses)),
        "vowel_ratio": ratio(vowels, n),
        "rhotic_ratio": ratio(of(*RHOTICS), n),
        "diphthong_ratio": ratio(of(*DIPHTHONGS), vowels),
        "has_syllabic": F.when(of(*SYLLABIC) > 0, 1.0).otherwise(0.0),
    }


def scalars(features: Column, phones: Column) -> dict[str, Column]:
    return acoustic_scalars(features) | phone_scalars(phones)
