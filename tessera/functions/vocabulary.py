"""The words and limits that results are made of."""

# Verdicts, statuses, segments and classes.
FIND, FAIR, OVERPRICED, TOO_LITTLE, BY_HAND = "НАХОДКА", "СПРАВЕДЛИВАЯ", "ПЕРЕОЦЕНЕНА", "НЕДОСТАТОЧНО ДАННЫХ", "РУЧНАЯ ПРОВЕРКА"
SCORED, NO_NUMBERS, NO_COMPARABLES = "scored", "insufficient_numeric_data", "no_comparables"
EXCLUDED_REVIEW, EXCLUDED_INSTALLMENT = "excluded_manual_review", "excluded_installment"
ECONOMY, COMFORT, BUSINESS, UNKNOWN_SEGMENT = "эконом", "комфорт", "бизнес", "неизвестен"
ROUGH, PRE_FINISHED, FINISHED = "черновая", "предчистовая", "чистовая"
RED_FLAGS = ["плесень", "залив", "пожар", "судебные_споры", "аварийное_состояние", "требует_капремонта", "несогласованная_перепланировка"]
SEVERE_FLAGS = ["плесень", "залив", "пожар", "судебные_споры", "аварийное_состояние", "несогласованная_перепланировка"]
# Reasons for a verdict.
REASON_NO_NUMBERS = "нет корректной цены и/или площади для price/m²"
REASON_NO_COMPARABLES = "нет сопоставимых объявлений в эталоне"
REASON_EXCLUDED = "строка не является пригодной для benchmark-пула"
REASON_NO_BASE = "нет устойчивой рыночной базы"
REASON_RED_FLAG = "есть red_flag: ценовую скидку нельзя честно оценить автоматически"
# Ladder.
LEAST_COHORT, FULL_COHORT, LEAST_SEGMENT_POOL = 3, 8, 8
NEAR_KM, FAR_KM, FAR_BAND = 1.0, 3.0, 0.30
EARTH_KM = 6371.0
LEVEL_WEIGHT = {"1-2": 1.00, "3": 0.90, "4": 0.78, "5": 0.62, "6": 0.42, "none": 0.0}
# Extreme floors.
LEAST_FLOOR, FLOOR_DEFAULT, FLOOR_LOW, FLOOR_HIGH = 30, 0.95, 0.90, 1.00
# Confidence of at least, then the discount for a find and the excess for overpriced.
THRESHOLDS = [(0.75, 0.10, -0.07), (0.55, 0.13, -0.10), (-1.0, 0.18, -0.15)]
# Sanity: hard bounds, and the factor and least group of the outlier filter.
PRICE_M2_BOUNDS, AREA_BOUNDS = (1000.0, 30000.0), (12.0, 300.0)
OUTLIER_FACTOR, LEAST_OUTLIER_GROUP = 3.0, 8
# Duplicates.
AREA_TOLERANCE, PRICE_TOLERANCE = 1.0, 0.03
OTHER_SELLER = "possible_duplicate_different_seller"
# The 27 columns of the journal of sent items.
JOURNAL = [
    "id", "url", "title", "reason", "price", "old_price", "source", "sent_at", "photo_count", "seller_type", "owner_name", "is_identity_confirmed",
    "seller_class", "seller_confidence", "verdict", "verdict_reason", "diff_pct", "base_price_m2_corrected", "value_score", "quality_evidence_score",
    "price_quality_score", "price_quality_label", "benchmark_confidence", "data_confidence", "cohort_level", "cohort_size", "data_warnings",
]
