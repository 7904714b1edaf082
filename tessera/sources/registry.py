"""Catalog of public spatial datasets: listing, cards and dry-run fetching."""

from __future__ import annotations

from dataclasses import asdict, dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


class FetchError(RuntimeError):
    """A dataset cannot be fetched."""


@dataclass(frozen=True)
class Dataset:
    id: str
    platform: str
    url_status: str
    size: str
    reader: str
    issue: int
    citation_key: str


# Id, platform, status of the address, declared size, reader, issue number, citation key.
_ROWS = (
    ("xenium_skin_melanoma", "Xenium", "verified_page", "377 genes; 150k-250k cells; 0.5-3 GB", "squidpy.read.xenium", 37, "tenx_xenium_skin_2023"),
    ("xenium_breast_janesick", "Xenium", "verified_page", "313 genes; ~110-170k cells; 0.4-1.5 GB (full outs 8-9 GB)", "squidpy.read.xenium", 38, "janesick2023xenium"),
    ("gse293199_tnbc_xenium", "Xenium", "verified_direct", "280-panel; ~160k cells; 13.6 GB full RAW.tar (subset ~3 GB)", "squidpy.read.xenium", 43, "omiclip2025"),
    ("xenium_lymph_node", "Xenium", "verified_page", "377-plex; 377,985 cells", "squidpy.read.xenium", 45, "tenx_xenium_lymph_node_2023"),
    ("xenium_prime_5k_cancer", "Xenium Prime", "verified_page", "~5,006-plex (skin) / ~5,100-plex (breast); 112,551 (skin) / 699,110 (breast) cells", "squidpy.read.xenium", 48, "tenx_xenium_prime_5k_2024"),
    ("cosmx_nsclc_nanostring", "CosMx SMI", "verified_page", "960-plex; 50k-100k cells per rep; 2-5 GB", "squidpy.read.nanostring", 39, "he2022cosmx"),
    ("cosmx_brain_frontal_cortex", "CosMx SMI", "gated", "6,078-plex; ~194k cells; ~3 GB", "squidpy.read.nanostring", 40, "bruker_cosmx_brain_2024"),
    ("cosmx_wtx_colon", "CosMx SMI", "gated", "~18,933-plex; multi-GB (size not printed on gated page)", "squidpy.read.nanostring", 49, "cosmx_wtx_18933plex_2024"),
    ("merfish_mouse_brain_receptor_map", "MERFISH", "unverified", "483 genes; 734,696 cells; 9 slices (3 coronal x 3 rep); 3-7 GB", "squidpy.read.vizgen", 41, "vizgen_mouse_brain_receptor_2021"),
    ("abc_atlas_zhuang_merfish", "MERFISH", "verified_page", "e.g. Zhuang-ABCA-1: 1122-plex, 4.2M cells, 147 sections", "anndata.read_h5ad (ABC Atlas AWS S3 public bucket)", 46, "zhang2023abcatlas"),
    ("vizgen_ffpe_io_merfish", "MERFISH", "gated", "500-plex; ~9M cells; 16 samples x 8 tumor types", "squidpy.read.vizgen", 47, "vizgen_ffpe_io_2022"),
    ("merfish_hypothalamus_moffitt", "MERFISH", "squidpy_builtin", "73,655 cells x 161 genes; 8 Bregma levels", "squidpy.datasets.merfish", 55, "moffitt2018merfish"),
    ("seqfish_mouse_embryo_lohoff", "seqFISH", "squidpy_builtin", "19,416 cells x 351 genes; 3 embryo FOVs", "squidpy.datasets.seqfish", 56, "lohoff2022seqfish"),
    ("wang2025_matched_tma", "Xenium + MERSCOPE + CosMx (matched)", "unverified", "matched TMAs: 17 tumor + 16 normal types across 3 high-plex platforms + scRNA", "per-platform: squidpy.read.xenium / read.vizgen / read.nanostring", 133, "wang2025ist"),
    ("gse208253_oscc_visium", "Visium v1", "verified_direct", "~18k genes; ~2.5k spots; 12 slides; 153.4 MB", "scanpy.read_visium / scanpy.read_10x_mtx", 42, "gse208253_oscc_visium"),
    ("ligrec_omnipath", "derived (any loaded AnnData with a cell-type label)", "derived", "n/a (no download)", "squidpy.gr.ligrec", 57, "turei2021omnipath"),
)

DATASETS = {r[0]: Dataset(*r) for r in _ROWS}
FIRST_PULL_ORDER = ("xenium_breast_janesick", "xenium_skin_melanoma", "cosmx_nsclc_nanostring", "merfish_mouse_brain_receptor_map")
FETCHABLE = ("verified_direct", "squidpy_builtin")


def all_issue_numbers() -> list[int]:
    return sorted({d.issue for d in DATASETS.values()})


def require_dataset(name: str) -> Dataset:
    if name not in DATASETS:
        raise FetchError(f"no dataset {name!r}; there are {sorted(DATASETS)}")
    return DATASETS[name]


def listing(spark: SparkSession) -> DataFrame:
    """One row a dataset."""
    return spark.createDataFrame([tuple(asdict(d).values()) for d in DATASETS.values()], "id string, platform string, url_status string, size string, reader string, issue int, citation_key string")


def _scalar(value: object) -> str:
    text = str(value)
    plain = text and text == text.strip() and not any(c in text for c in ":#{}[]&*!|>'\"%@`,\n") and text[0] not in "-?"
    return text if plain else '"' + text.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n") + '"'


def card_text(name: str) -> str:
    """The dataset's card as YAML."""
    return "".join(f"{k}: {_scalar(v)}\n" for k, v in asdict(require_dataset(name)).items())


def emit_cards(folder: str) -> list[str]:
    Path(folder).mkdir(parents=True, exist_ok=True)
    out = []
    for name in DATASETS:
        path = Path(folder, f"{name}.yaml")
        path.write_text(card_text(name), encoding="utf-8")
        out.append(str(path))
    return out


def fetch(name: str, download: bool = False) -> str:
    """What a fetch would do; only a dry run is possible here, and downloads of gated or unverified addresses are refused."""
    data = require_dataset(name)
    if not download:
        return f"dry run: {data.id} ({data.url_status}) by {data.reader}"
    if data.url_status not in FETCHABLE:
        raise FetchError(f"{name} is {data.url_status}; get it by hand")
    raise FetchError("downloads are not part of this engine; load the files with Spark readers")
