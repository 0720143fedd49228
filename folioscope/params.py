"""Lexicons, weights, thresholds and templates. All are defaults that callers may replace."""

from __future__ import annotations

from dataclasses import dataclass

# --- Fixed values: results must agree on these lists and numbers. -------------------------------
SECTIONS = ("summary", "experience", "education", "skills")
SECTION_HEADINGS = {
    "summary": (
        "summary", "professional summary", "profile", "professional profile", "about", "about me",
        "objective", "career objective", "ringkasan", "ringkasan profesional", "profil", "profil profesional",
        "tentang", "tentang saya",
    ),
    "experience": (
        "experience", "work experience", "professional experience", "employment", "employment history",
        "work history", "pengalaman", "pengalaman kerja", "pengalaman profesional", "riwayat pekerjaan",
        "riwayat kerja",
    ),
    "education": (
        "education", "education background", "educational background", "academic background", "pendidikan",
        "riwayat pendidikan", "latar belakang pendidikan", "pendidikan formal",
    ),
    "skills": (
        "skills", "skill", "technical skills", "hard skills", "soft skills", "skills & tools", "core competencies",
        "competencies", "keahlian", "kemampuan", "keterampilan", "kompetensi",
    ),
}
OTHER_HEADINGS = (
    "projects", "project", "personal projects", "proyek", "proyek pribadi", "portfolio", "portofolio",
    "organization", "organizations", "organisasi", "pengalaman organisasi", "organizational experience",
    "volunteer", "volunteering", "kegiatan", "kepanitiaan", "leadership", "achievements", "awards",
    "honors", "prestasi", "penghargaan", "certifications", "certification", "certificates", "licenses",
    "sertifikasi", "sertifikat", "training", "courses", "pelatihan", "kursus", "languages", "language",
    "bahasa", "interests", "hobbies", "hobi", "minat", "references", "referensi", "publications",
    "publikasi", "contact", "kontak", "personal information", "informasi pribadi", "data diri",
)
STOPWORDS = (
    "a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "in", "into",
    "is", "it", "of", "on", "or", "that", "the", "this", "to", "was", "we", "with",
    "dan", "dari", "di", "kami", "kita", "ke", "pada", "sebagai", "untuk", "yang",
    "adalah", "akan", "telah", "sedang", "agar", "dalam", "tentang", "antara",
    "setelah", "sebelum", "serta", "atau", "juga", "hanya", "semua", "setiap",
    "mencari", "seorang", "dengan", "tim", "kandidat", "memiliki", "membutuhkan",
    "bergabung", "bekerja", "berpengalaman", "minimal", "tahun", "mampu", "dapat",
)
CHECK_WEIGHTS = {"keyword": 40, "skills": 20, "sections": 15, "formatting": 10, "quantified": 10, "readability": 5}
CHECK_ORDER = {check: n for n, check in enumerate(CHECK_WEIGHTS)}
PASS_FROM, WARN_FROM = 80, 60
KEY_PREFIXES = (
    ("sk-or-", "openrouter"), ("sk-ant-", "anthropic"), ("sk-proj-", "openai"), ("sk-svcacct-", "openai"),
    ("AIza", "google"), ("gsk_", "groq"), ("xai-", "xai"), ("pplx-", "perplexity"), ("fw_", "fireworks"),
    ("csk-", "cerebras"), ("hf_", "huggingface"), ("nvapi-", "nvidia"),
)
MISTRAL_FAMILY = "^(mistral|codestral|magistral|ministral|pixtral|devstral|voxtral|open-mistral|open-mixtral)"
OPENAI_FAMILY = r"^(gpt-|o\d|chatgpt-|codex-)"
#: (first address, prefix length, kind); the first that matches wins.
IPV4_RANGES = (
    ("100.100.100.200", 32, "blocked"),
    ("0.0.0.0", 8, "blocked"), ("169.254.0.0", 16, "blocked"), ("192.0.0.0", 24, "blocked"),
    ("192.0.2.0", 24, "blocked"), ("192.88.99.0", 24, "blocked"), ("198.18.0.0", 15, "blocked"),
    ("198.51.100.0", 24, "blocked"), ("203.0.113.0", 24, "blocked"), ("224.0.0.0", 4, "blocked"), ("240.0.0.0", 4, "blocked"),
    ("127.0.0.0", 8, "private"), ("10.0.0.0", 8, "private"), ("172.16.0.0", 12, "private"), ("192.168.0.0", 16, "private"),
    ("100.64.0.0", 10, "private"),
)
BULLET_GLYPHS = "-*•·●▪‣○◦■□◆◇►▸➢➤✓✔–»"
INLINE_GLYPHS = "●•▪‣○◦■◆►➢"
# --------------------------------------------------------------------------------------------------

#: Every kind of white space a reader sees as one, as a regular-expression class.
#: The rare members are looked at behind one range, so that a letter costs two comparisons and not eleven.
WS = r"[\t\n\x{B}\f\r \x{A0}[\x{1680}-\x{FEFF}&&[\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]]]"
NOT_WS = WS.replace("[", "[^", 1)
WS_CHARS = "\t\n\v\f\r \u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"  # the members of WS


@dataclass(frozen=True)
class HiddenText:
    contrast: float = 1.25
    tiny: float = 2.0
    faint: float = 0.1
    painted: float = 0.05
    opaque: float = 0.9
    off_page: float = 1.0
    baseline: float = 0.3
    cell: float = 96.0  # side of a cell of the page grid, in points
    grid: int = 16  # cells a side; the last ones hold all beyond
    image_share: float = 0.5
    samples: int = 3
    sample_chars: int = 80


@dataclass(frozen=True)
class Admission:
    file_bytes: int = 4 << 20
    header_bytes: int = 1024
    pages: int = 10
    page_side: float = 14_400
    runs_a_page: int = 20_000
    shapes_a_page: int = 5_000
    least_chars: int = 50
    posting_chars: int = 20_000
    short_chars: int = 200


@dataclass(frozen=True)
class Layout:
    line_shift: float = 0.5
    space_gap: float = 0.1
    line_join: float = 1.0
    column_gap: float = 50
    column_lines: int = 2
    column_shared: int = 2
    column_span: float = 0.5
    column_density: float = 0.35
    bar_thickness: float = 3
    bar_page_share: float = 0.6
    bar_aspect: float = 3
    bar_align: float = 2
    bar_slot: float = 1
    bar_gap: float = 36
    graphic_side: float = 24


@dataclass(frozen=True)
class Rubric:
    words_min: int = 50
    words_max: int = 1200
    concise_words: int = 25
    table_penalty: int = 15
    tab_penalty: int = 10
    layout_penalty: int = 15
    suggestions: int = 3
    snippet: int = 80
    missing_listed: int = 15


@dataclass(frozen=True)
class AnswerLimits:
    raw: int = 200_000
    detail: int = 600
    weakness: int = 300
    weaknesses: int = 8
    title: int = 120
    description: int = 800
    snippet: int = 200
    suggestions: int = 10
    reason: int = 400
    item: int = 120
    items: int = 5
    jobs: int = 5
