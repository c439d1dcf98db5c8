"""Explicit schemas of the record files: nothing is inferred on reading."""

from __future__ import annotations

KB_RECORD = """question_id string, question string, answer array<string>, disease string, topic string, pico string,
source struct<title:string,year:int,organization:string,source_file:string>, synonyms map<string,array<string>>, created_at string, search_text string"""
QUESTION = "question_id string, question string, pico string"
PICO = "Aspect string, Index string, Question string, P string, I string, C string, O string, S string"
OUTCOME = """outcome_uid string, clinical_question string, population string, intervention string, comparator string, outcome string,
importance string, related_paper_list array<string>, assessment_results string"""
PAPER = """title string, paper_uid string, reference string, pmid string, save_folder_path string, authors string, year string,
study_design string, abstract string, url string, doi string, journal string, characteristics string"""
LITERATURE = "Paper_Index string, Title string, Published string, Abstract string, `Digital Object Identifier` string, `Publication Types` array<string>"
SCREENING = """Paper_Index string, Title string, Published string, Abstract string, `Digital Object Identifier` string, `Publication Types` string,
paper string, clinical_question string, llm_record_screening_reason string, llm_record_screening_verdict string"""
INCLUDED_STUDY = "PICO_IDX string, Date string, Ref string, PMID string, Dataset string"
MEDLINE = """MedlineCitation struct<PMID:struct<_VALUE:string>,Article:struct<ArticleTitle:struct<_VALUE:string>,
Abstract:struct<AbstractText:array<struct<_Label:string,_VALUE:string>>>,ArticleDate:struct<Year:string,Month:string,Day:string>,
ELocationID:array<struct<_EIdType:string,_VALUE:string>>,PublicationTypeList:struct<PublicationType:array<struct<_UI:string,_VALUE:string>>>>>"""
TEI = "head string, p array<struct<s:array<struct<_coords:string,_VALUE:string>>>>"

# The designs a paper may have, by name.
STUDY_DESIGNS = {
    "SYSTEMATIC_REVIEW": "Systematic Review",
    "META_ANALYSIS": "Meta-Analysis",
    "RANDOMIZED_CONTROLLED_TRIAL": "Randomized Controlled Trial",
    "COHORT_STUDY": "Cohort Study",
    "OTHER_OBSERVATIONAL_STUDY": "Other Observational Study",
    "NOT_APPLICABLE": "Not Applicable",
}
