"""Defaults and small dimensions. The values marked fixed must equal those of the system
whose results are matched."""

from __future__ import annotations

from dataclasses import dataclass

# -- fixed values: retrieval -----------------------------------------------------------
VECTOR_TOP_K, TEXT_TOP_K = 7, 5
RRF_K, STANDALONE_BOOST = 60, 1.2
TOP_PARENTS, CONTEXT_CHARS, MIN_TRUNCATED = 4, 5000, 100

# -- fixed values: dialogue ------------------------------------------------------------
MAX_INPUT_CHARS, SUMMARIZE_CHARS, MIN_QUERY_CHARS = 3000, 2000, 5
HISTORY_TURNS, API_HISTORY, MESSAGE_CHARS = 2, 15, 400
CACHE_SIMILARITY, CACHE_SIZE, CACHE_TTL_SECONDS = 0.80, 200, 24 * 3600
RATE_LIMIT, RATE_WINDOW_SECONDS, SESSION_TTL_SECONDS = 10, 60, 300
SUMMARY_TRIGGER, SUMMARY_CHARS = 300, 120
USER_NAME, OTHER_NAME = "Người dùng", "Bot"
SESSIONS, TASKS, LOOPS = 1000, 100, 1

# -- fixed values: sites of a web search, in order -------------------------------------
SITES = [
    "ufm.edu.vn", "tuyensinh.ufm.edu.vn", "nhaphoc.ufm.edu.vn", "uis.ufm.edu.vn", "pdt.ufm.edu.vn", "phongcongtacsinhvien.ufm.edu.vn", "thuvien.ufm.edu.vn",
    "daotaosdh.ufm.edu.vn", "isfm.ufm.edu.vn", "ice.ufm.edu.vn", "ufm-elearning.edu.vn", "jfm.ufm.edu.vn", "jfm.edu.vn", "kytucxa.ufm.edu.vn",
]
PRESS_SITES = ["thanhnien.vn", "vnexpress.net", "tuoitre.vn", "dantri.com.vn", "giaoducthoidai.vn"]

# -- fixed values: patterns ------------------------------------------------------------
BANNED = [r"ch[íi]nh\s*tr[ịi]", r"t[ôo]n\s*gi[áa]o", r"b[ạa]o\s*l[ựu]c", r"gi[ếe]t", r"h[a@4]ck", r"c[ờo]\s*b[ạa]c", r"ma\s*t[úu]y"]
INJECTION = [r"ignore.*(instruction|rule|prompt)", r"system\s*prompt", r"api[\s_-]*key|secret[\s_-]*key", r"jailbreak|bypass|override", r"\bsudo\b|\broot\b"]
TEENCODE = {
    "ko": "không", "k": "không", "hk": "không", "dc": "được", "đc": "được", "trc": "trước", "ns": "nói", "ntn": "như thế nào",
    "lm": "làm", "mk": "mình", "mn": "mọi người", "vs": "với", "r": "rồi", "j": "gì",
}
HEADER_INJECTION = [r"\{\{.*\}\}", r"\{%.*%\}", r"\$\(.*\)", r"\$\{.*\}"]
DANGEROUS_TAG = r"<\s*(script|iframe|object|embed|form|meta|link|base)\b"
LEGACY_LEVELS = [(r"trình\s+độ\s+tiến\s+sĩ", "tien_si"), (r"trình\s+độ\s+thạc\s+sĩ", "thac_si"), (r"tiến\s+sĩ", "tien_si"), (r"thạc\s+sĩ", "thac_si"), (r"đại\s+học", "dai_hoc")]
LEVELS = [
    ("tien_si", [r"ti[eế]n\s*s[iĩỹ]", r"nghiên\s*cứu\s*sinh", r"\bncs\b", r"\bts\b(?!\s*\d)", r"trình\s*độ\s*ti[eế]n", r"đào\s*tạo\s*ti[eế]n", r"h[oọ]c\s*v[iị]\s*ti[eế]n"]),
    ("thac_si", [r"th[aạ]c\s*s[iĩỹ]", r"cao\s*h[oọ]c", r"\bths\b", r"trình\s*độ\s*th[aạ]c", r"đào\s*tạo\s*th[aạ]c", r"ch[uư][oơ]ng\s*trình\s*th[aạ]c"]),
    ("dai_hoc", [r"(?<!sau\s)(?<!trường\s)đ[aạ]i\s*h[oọ]c(?!\s*ufm)", r"c[uử]\s*nhân", r"k[ỹy]\s*sư", r"\bđh\b", r"h[eệ]\s*chính\s*quy", r"chính\s*quy", r"trình\s*độ\s*đ[aạ]i"]),
]
PROGRAMS = [
    ("Quản Trị Kinh Doanh", [r"qt\s*kd", r"quản\s*trị\s*kinh\s*doanh"]),
    ("Kinh Doanh Quốc Tế", [r"kdqt", r"kinh\s*doanh\s*quốc\s*tế", r"kinh\s*doanh\s*quoc\s*te"]),
    ("Marketing", [r"\bmarketing\b", r"\bmkt\b", r"tiếp\s*thị"]),
    ("Tài Chính Ngân Hàng", [r"tài\s*chính\s*ngân\s*hàng", r"tài\s*chính", r"tc\s*nh", r"ngân\s*hàng"]),
    ("Kế Toán", [r"kế\s*toán", r"ke\s*toan"]),
    ("Kiểm Toán", [r"kiểm\s*toán", r"kiem\s*toan"]),
    ("Luật Kinh Tế", [r"luật\s*kinh\s*tế", r"luật", r"luat"]),
    ("Kinh Tế", [r"\bkinh\s*tế\b(?!\s*lượng)"]),
    ("Kinh Tế Quốc Tế", [r"kinh\s*tế\s*quốc\s*tế", r"ktqt"]),
    ("Quản Trị Nhân Lực", [r"quản\s*trị\s*nhân\s*lực", r"nhân\s*sự", r"qtns", r"qtnl"]),
    ("Hệ Thống Thông Tin Quản Lý", [r"hệ\s*thống\s*thông\s*tin", r"htttql", r"\bmis\b"]),
    ("Thương Mại Điện Tử", [r"thương\s*mại\s*điện\s*tử", r"tmđt", r"tmdt", r"e-?commerce"]),
    ("Logistics", [r"logistics", r"chuỗi\s*cung\s*ứng", r"supply\s*chain"]),
    ("Du Lịch", [r"du\s*lịch", r"du\s*lich", r"tourism"]),
    ("Ngôn Ngữ Anh", [r"ngôn\s*ngữ\s*anh", r"tiếng\s*anh", r"\bnna\b", r"english"]),
]
INTENT_ACTIONS = {
    "HOC_PHI_HOC_BONG": "PROCEED_RAG", "THU_TUC_HANH_CHINH": "PROCEED_RAG",
    "THONG_TIN_TUYEN_SINH": "PROCEED_RAG_UFM_SEARCH", "CHUONG_TRINH_DAO_TAO": "PROCEED_RAG_UFM_SEARCH", "DOI_SONG_SINH_VIEN": "PROCEED_RAG_UFM_SEARCH",
    "TAO_MAU_DON": "PROCEED_FORM",
    "THANH_TICH_UFM": "PROCEED_RAG_PR_SEARCH", "SO_SANH_TRUONG": "PROCEED_RAG_PR_SEARCH", "CO_HOI_VIEC_LAM": "PROCEED_RAG_PR_SEARCH",
    "HO_TRO_SINH_VIEN": "PROCEED_CARE", "KHIEU_NAI_GOP_Y": "PROCEED_CARE",
    "CHAO_HOI": "GREET", "KHONG_XAC_DINH": "CLARIFY",
    "BOI_NHO_DOI_THU": "BLOCK_FALLBACK", "DOI_HOI_CAM_KET": "BLOCK_FALLBACK", "TAN_CONG_HE_THONG": "BLOCK_FALLBACK", "CAU_HOI_LAC_DE": "BLOCK_FALLBACK",
}
FALLBACK_INTENT, DEFAULT_ACTION = "KHONG_XAC_DINH", "CLARIFY"
PROGRAM_CODES = {
    ("tien_si", "tài chính - ngân hàng"): "9340201", ("tien_si", "quản trị kinh doanh"): "9340101", ("tien_si", "quản lý kinh tế"): "9310110",
    ("thac_si", "tài chính - ngân hàng"): "8340201", ("thac_si", "quản trị kinh doanh"): "8340101", ("thac_si", "quản lý kinh tế"): "8310110",
    ("thac_si", "marketing"): "8340115", ("thac_si", "kinh doanh quốc tế"): "8340120", ("thac_si", "kế toán"): "8340301",
    ("thac_si", "toán kinh tế"): "8310108", ("thac_si", "kinh tế học"): "8310101", ("thac_si", "luật kinh tế"): "8380107",
}


@dataclass(frozen=True)
class ChunkLimits:
    """Fixed values of the chunkers, in characters."""

    parent: int = 6000
    parent_body: int = 240
    leaf_body: int = 90
    part: int = 500
    heading_depth: int = 4
    fallback: int = 2800
    overlap_sentences: int = 2
    block: int = 300
    hard_block: int = 600
    child: int = 2400
