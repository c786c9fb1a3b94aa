"""Word lists and the taxonomy that the keyword operators use. All are fixed values: results depend on them."""

from __future__ import annotations

# The category taxonomy, main category -> subcategory -> categories. Order matters: the first match wins.
TAXONOMY: dict[str, dict[str, list[str]]] = {
    "Technology": {
        "Programming": ["Python", "JavaScript", "Java", "C++", "Go", "Rust"],
        "Web Development": ["Frontend", "Backend", "Full Stack", "APIs", "Frameworks"],
        "Data Science": ["Machine Learning", "AI", "Analytics", "Big Data", "Statistics"],
        "DevOps": ["Docker", "Kubernetes", "CI/CD", "Cloud", "Infrastructure"],
        "Mobile": ["iOS", "Android", "React Native", "Flutter", "Cross Platform"],
        "Security": ["Cybersecurity", "Penetration Testing", "Cryptography", "Privacy"],
    },
    "Business": {
        "Startups": ["Entrepreneurship", "Funding", "Business Model", "Growth"],
        "Marketing": ["Digital Marketing", "Content Marketing", "SEO", "Social Media"],
        "Management": ["Leadership", "Team Building", "Strategy", "Operations"],
        "Finance": ["Investment", "Accounting", "Financial Planning", "Economics"],
        "Sales": ["Lead Generation", "CRM", "Sales Strategy", "Customer Success"],
    },
    "Education": {
        "Online Learning": ["Courses", "Tutorials", "Certifications", "MOOCs"],
        "Academic": ["Research", "Papers", "Studies", "Universities"],
        "Skills Development": ["Career Growth", "Professional Development", "Training"],
        "Teaching": ["Pedagogy", "Educational Technology", "Curriculum"],
    },
    "Science": {
        "Research": ["Academic Research", "Scientific Studies", "Publications"],
        "Mathematics": ["Statistics", "Algorithms", "Mathematical Modeling"],
        "Physics": ["Quantum Physics", "Theoretical Physics", "Applied Physics"],
        "Biology": ["Biotechnology", "Genetics", "Medical Research"],
    },
    "Lifestyle": {
        "Health": ["Fitness", "Nutrition", "Mental Health", "Wellness"],
        "Travel": ["Destinations", "Travel Tips", "Culture", "Adventure"],
        "Hobbies": ["Photography", "Gaming", "Reading", "Sports"],
        "Personal Development": ["Self Improvement", "Productivity", "Mindfulness"],
    },
}

# Points for a name of each level found in a text.
LEVEL_WEIGHTS = {"main": 5, "sub": 3, "leaf": 2}

# The tag vocabulary by category; order matters.
TAG_VOCABULARY: dict[str, list[str]] = {
    "technology": ["programming", "software", "development", "coding", "framework", "library", "tool", "api", "database"],
    "language": ["python", "javascript", "java", "c++", "go", "rust", "typescript", "php", "ruby", "swift"],
    "platform": ["web", "mobile", "desktop", "cloud", "aws", "azure", "gcp", "docker", "kubernetes"],
    "methodology": ["agile", "devops", "testing", "automation", "ci/cd", "deployment", "monitoring"],
    "domain": ["fintech", "healthcare", "ecommerce", "gaming", "education", "automotive", "IoT"],
    "skill_level": ["beginner", "intermediate", "advanced", "expert", "tutorial", "guide"],
    "content_type": ["article", "tutorial", "documentation", "news", "opinion", "research", "case-study"],
    "business": ["startup", "enterprise", "saas", "b2b", "b2c", "marketing", "sales", "strategy"],
}
# Words that are no tags.
TAG_STOP_WORDS = ["the", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "by", "a", "an"]

# Words that decide a text's tone, depth and kind.
POSITIVE = ["excellent", "great", "amazing", "wonderful", "fantastic", "good", "useful", "helpful", "valuable"]
NEGATIVE = ["bad", "terrible", "awful", "horrible", "useless", "poor", "disappointing", "frustrating"]
COMPLEX = ["algorithm", "implementation", "architecture", "framework", "technical", "advanced", "complex"]
SIMPLE = ["basic", "simple", "easy", "beginner", "introduction", "overview"]
CONTENT_TYPES = [
    ("Tutorial", ["tutorial", "how to"]), ("Review", ["review", "comparison"]), ("News", ["news", "announcement"]),
    ("Research", ["research", "study"]), ("Opinion", ["opinion", "thoughts"]),
]
TECH_TOPICS = ["python", "javascript", "react", "machine learning", "ai", "blockchain", "docker", "kubernetes"]
BUSINESS_TOPICS = ["startup", "business", "marketing", "sales", "strategy", "growth"]
INSIGHT_WORDS = ["important", "key", "crucial", "essential", "main", "primary", "significant"]

# Marks of threads, their parts and their topics.
THREAD_MARKS = ["thread", "1/", "1/n", "👇", "see below", "continued", "part 1", "first tweet"]
CONTINUES = ["continued", "more in next tweet", "thread continues", "...", "to be continued"]
INTRODUCES = ["thread", "today i", "let me explain", "here's how"]
CONCLUDES = ["in conclusion", "to summarize", "finally", "that's it"]
CALLS = ["follow me", "retweet", "like if", "share this", "subscribe"]
THREAD_TOPICS = {
    "technology": ["tech", "software", "programming", "development", "coding", "ai", "ml"],
    "business": ["startup", "business", "entrepreneur", "marketing", "sales", "strategy"],
    "finance": ["money", "finance", "investment", "crypto", "stocks", "trading"],
    "career": ["career", "job", "work", "professional", "skills", "learning"],
    "productivity": ["productivity", "efficiency", "time", "management", "workflow"],
    "design": ["design", "ui", "ux", "visual", "creative", "art"],
    "health": ["health", "fitness", "wellness", "mental", "exercise"],
}

# Marks of live and short videos, and their topics.
LIVE = ["live", "streaming", "stream", "live stream"]
SHORT = ["shorts", "short", "#shorts"]
VIDEO_TOPICS = {
    "tutorial": ["tutorial", "how to", "guide", "learn", "lesson"],
    "review": ["review", "comparison", "vs", "unboxing"],
    "gaming": ["game", "gaming", "gameplay", "playthrough", "walkthrough"],
    "music": ["music", "song", "album", "artist", "band"],
    "tech": ["technology", "tech", "gadget", "device", "software"],
    "entertainment": ["funny", "comedy", "entertainment", "reaction"],
    "education": ["education", "educational", "science", "history", "documentary"],
    "vlog": ["vlog", "daily", "life", "routine", "day in the life"],
}

# What the address checks know.
SCHEMES = ["http", "https", "ftp", "ftps"]
BLOCKED = ["localhost", "127.0.0.1", "0.0.0.0"]
SUSPICIOUS = [r"\.exe$", r"\.zip$", r"\.rar$", r"\.tar\.gz$", r"javascript:", r"data:", r"blob:", r"\.onion$"]
TWITTER_HOSTS = ["twitter.com", "x.com", "www.twitter.com", "www.x.com"]
PLATFORMS = [("youtube", ["youtube.com", "youtu.be"]), ("vimeo", ["vimeo.com"]), ("dailymotion", ["dailymotion.com"]), ("twitch", ["twitch.tv"]), ("tiktok", ["tiktok.com"])]


def taxonomy_rows() -> list[tuple[int, str, str | None, str, str, int]]:
    """(ord, main, sub, name, level, weight), in the order of the taxonomy."""
    rows: list[tuple[int, str, str | None, str, str, int]] = []
    for main, subs in TAXONOMY.items():
        rows.append((len(rows), main, None, main, "main", LEVEL_WEIGHTS["main"]))
        for sub, leaves in subs.items():
            rows.append((len(rows), main, sub, sub, "sub", LEVEL_WEIGHTS["sub"]))
            for leaf in leaves:
                rows.append((len(rows), main, sub, leaf, "leaf", LEVEL_WEIGHTS["leaf"]))
    return rows


def tag_rows() -> list[tuple[int, int, str, str]]:
    """(cat_ord, kw_ord, category, keyword)."""
    return [(i, j, c, k) for i, (c, ks) in enumerate(TAG_VOCABULARY.items()) for j, k in enumerate(ks)]
