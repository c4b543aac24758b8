"""Schemas (DDL) of the tables that stages read and write."""

from __future__ import annotations

SCHEMAS = {
    "news_index": "title string, link string, category string, news_date string, fetch_date timestamp",
    "news_article": "id string, title string, category string, news_date string, content string, url string, fetch_date string, image_links array<string>, has_images boolean",
    "image_mapping": "original_id string, title string, news_date string, folder_path string, image_paths array<string>, link string, has_images boolean, year int, processed boolean, basic_filtered boolean",
    "news_filtered": "original_id string, title string, content string, news_date string, category string, link string, valid_images array<struct<path:string,abs_path:string>>, rejected_images array<struct<path:string,reason:string>>, has_valid_images boolean, basic_filtered boolean, quality_processed boolean",
    "news_quality": "original_id string, title string, content string, news_date string, category string, link string, images array<struct<path:string,clarity_weight:double,text_weight:double,text_level:string,text_length:int,quality_score:double,is_high_quality:boolean>>, has_high_quality_images boolean, avg_clarity_weight double, avg_text_weight double, avg_quality_score double, diversity_score double",
    "image_sentiment": "original_id string, image_index int, image_path string, predicted_class int, negative_likelihood double, news_date string, title string, clarity_weight double, text_weight double, weight double, quality_score double, diversity_score double, unique_ratio double, weighted_score double, timestamp timestamp",
    "text_sentiment": "original_id string, news_date string, title string, sentiment_class int, sentiment_label string, textneg_likelihood double, processed_time timestamp",
    "daily_photopes": "news_date date, total_images bigint, negative_count bigint, PhotoPes double, PhotoPes_likelihood double, WeightedPhotoPes double, avg_quality_score double, avg_negative_likelihood double, year string",
    "daily_textpes": "news_date date, total_count bigint, negative_count bigint, positive_count bigint, TextPes double, TextPes_likelihood double, WeightedTextPes double, avg_quality_score double, year string",
    "weight_params": "kind string, midpoint double, steepness double, min_weight double, max_weight double",
    "dead_letter": "url string, doc_id string, folder_path string, error string, timestamp timestamp",
}
