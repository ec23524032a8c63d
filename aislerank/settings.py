"""Defaults of every tunable.  Each is a parameter of the job that uses it."""

from __future__ import annotations

from dataclasses import dataclass, field

# Columns of the raw catalogue.
RAW_COLUMNS = (
    "product_id", "product_name", "category", "discounted_price", "actual_price",
    "discount_percentage", "rating", "rating_count", "about_product", "img_link",
    "product_link",
)

# Price buckets, half-open [low, high).
PRICE_BUCKETS = (
    (0.0, 500.0, "Budget"),
    (500.0, 2000.0, "Mid-Range"),
    (2000.0, 10000.0, "Premium"),
    (10000.0, 999999.0, "Luxury"),
)

# Neighbour of each bucket, one direction only.
ADJACENT_BUCKET = {
    "Budget": "Mid-Range",
    "Mid-Range": "Budget",
    "Premium": "Mid-Range",
    "Luxury": "Premium",
}

# Complementary top-level categories.
COMPLEMENTS = {
    "Electronics": ["Computers & Accessories", "Clothing", "Books"],
    "Computers & Accessories": ["Electronics", "Books"],
    "Clothing": ["Beauty & Personal Care", "Sports & Outdoors"],
    "Beauty & Personal Care": ["Clothing", "Sports & Outdoors"],
    "Sports & Outdoors": ["Clothing", "Health & Nutrition"],
    "Home & Kitchen": ["Electronics", "Appliances"],
    "Appliances": ["Home & Kitchen", "Electronics"],
    "Books": ["Electronics", "Computers & Accessories"],
    "Gaming": ["Electronics", "Computers & Accessories"],
}

# Share of each signal in the blended ranking.
HYBRID_WEIGHTS = {
    "content_based": 0.35,
    "category_similarity": 0.25,
    "brand_similarity": 0.15,
    "price_similarity": 0.10,
    "popularity": 0.10,
    "rating": 0.05,
}

# Strength of each interaction type.
EVENT_WEIGHTS = {
    "view": 1.0,
    "repeat_view": 1.5,
    "wishlist": 2.0,
    "cart": 3.0,
    "purchase": 5.0,
}


@dataclass(frozen=True)
class TextModel:
    """Parameters of the term weighting."""

    max_features: int = 5000
    min_df: int = 2
    max_df: float = 0.95
    bigrams: bool = True


@dataclass(frozen=True)
class SessionModel:
    """Parameters of session personalisation."""

    weights: dict = field(default_factory=lambda: dict(EVENT_WEIGHTS))
    decay: float = 0.85
    mmr_lambda: float = 0.60
    min_norm: float = 1e-8
    pool_floor: int = 50
