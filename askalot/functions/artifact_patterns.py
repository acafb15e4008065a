"""Traces of the survey instrument in a codebook's texts: patterns by group, their severity and what to do about them."""

from __future__ import annotations


# Fixed values: (group, name, pattern), matched in any case.
PATTERNS: list[tuple[str, str, str]] = [
    ("interviewer_instructions", "showcard_instruction", r"\(?\s*SHOWCARD\s*\)?"),
    ("interviewer_instructions", "showcard_instruction", r"\[?\s*SHOW\s*CARD\s*\]?"),
    ("interviewer_instructions", "do_not_read", r"\[?\s*[Dd]o\s*not\s*read\s*[:\]]?"),
    ("interviewer_instructions", "do_not_read", r"\[?\s*DO\s*NOT\s*READ\s*[:\]]?"),
    ("interviewer_instructions", "do_not_read", r"\(?\s*[Dd]o\s*not\s*read\s*[:\)]?"),
    ("interviewer_instructions", "interviewer_note", r"\[?\s*[Ii]nterviewer\s*:?\s*[^\]]*\]?"),
    ("interviewer_instructions", "interviewer_note", r"\[?\s*INTERVIEWER\s*:?\s*[^\]]*\]?"),
    ("interviewer_instructions", "note_instruction", r"\[?\s*[Nn]ote\s*:?\s*[^\]]*\]?"),
    ("interviewer_instructions", "note_instruction", r"\[?\s*NOTE\s*:?\s*[^\]]*\]?"),
    ("interviewer_instructions", "instruction_note", r"\[?\s*[Ii]nstruction\s*:?\s*[^\]]*\]?"),
    ("interviewer_instructions", "read_aloud", r"\[?\s*[Rr]ead\s*out\s*[^\]]*\]?"),
    ("interviewer_instructions", "read_aloud", r"\[?\s*READ\s*OUT\s*[^\]]*\]?"),
    ("interviewer_instructions", "read_aloud", r"\(?\s*[Rr]ead\s*out\s*options?\s*\)?"),
    ("interviewer_instructions", "read_aloud", r"READ\s*EACH\s*ITEM"),
    ("interviewer_instructions", "single_answer_instruction", r"\(?\s*ONE\s*ANSWER\s*ONLY\s*\)?"),
    ("interviewer_instructions", "single_answer_instruction", r"\(?\s*[Oo]ne\s*answer\s*only\s*\)?"),
    ("interviewer_instructions", "multiple_answer_instruction", r"\[?\s*[Mm]ultiple\s*answers?\s*allowed\s*\]?"),
    ("interviewer_instructions", "probe_instruction", r"\[?\s*[Pp]robe\s*[^\]]*\]?"),
    ("interviewer_instructions", "probe_instruction", r"\[?\s*PROBE\s*[^\]]*\]?"),
    ("interviewer_instructions", "optional_marker", r"<\s*[Oo]ptional\s*>"),
    ("interviewer_instructions", "optional_marker", r"<\s*OPTIONAL\s*>"),
    ("interviewer_instructions", "gbs_marker", r"\[?\s*GBS\s*\]?"),
    ("interviewer_instructions", "coding_only_instruction", r"FOR\s*CODING\s*ONLY"),
    ("interviewer_instructions", "coding_only_instruction", r"[Ff]or\s*coding\s*only"),
    ("interviewer_instructions", "if_volunteered", r"\(?\s*if\s*volunteered\s*\)?"),
    ("interviewer_instructions", "if_volunteered", r"\(?\s*IF\s*VOLUNTEERED\s*\)?"),
    ("interviewer_instructions", "interviewer_assessment", r"ASSESSMENT\s*OF\s*THE\s*INTERVIEWEE"),
    ("interviewer_instructions", "interviewer_assessment", r"[Tt]ake\s*as\s*reference"),
    ("placeholders", "country_placeholder", r"\[country\s*name?\]"),
    ("placeholders", "country_placeholder", r"\[Country\s*Name?\]"),
    ("placeholders", "country_placeholder", r"\[COUNTRY\]"),
    ("placeholders", "country_placeholder", r"\[country\]"),
    ("placeholders", "country_placeholder", r"\[Country\s*X?\]"),
    ("placeholders", "country_placeholder", r"\(country\)"),
    ("placeholders", "country_placeholder", r"\(COUNTRY\)"),
    ("placeholders", "country_placeholder", r"\(Country\)"),
    ("placeholders", "country_placeholder", r"\(COUNTRY´S\)"),
    ("placeholders", "country_placeholder", r"\(COUNTRY'S\)"),
    ("placeholders", "country_placeholder", r"\(country's\)"),
    ("placeholders", "leader_placeholder", r"\[president\]"),
    ("placeholders", "leader_placeholder", r"\[President\]"),
    ("placeholders", "leader_placeholder", r"\[prime\s*minister\]"),
    ("placeholders", "leader_placeholder", r"\[Prime\s*Minister\]"),
    ("placeholders", "leader_placeholder", r"\[PM\]"),
    ("placeholders", "leader_placeholder", r"\[name\s*of\s*president[^\]]*\]"),
    ("placeholders", "leader_placeholder", r"\[current\s*ruling[^\]]*\]"),
    ("placeholders", "leader_placeholder", r"\(president['´’]?s?\s*name\)"),
    ("placeholders", "leader_placeholder", r"\(PRESIDENT['´’]?S?\s*NAME\)"),
    ("placeholders", "year_placeholder", r"\[year\]"),
    ("placeholders", "year_placeholder", r"\[Year\]"),
    ("placeholders", "year_placeholder", r"\[YEAR\]"),
    ("placeholders", "year_placeholder", r"\[20\d{2}\]"),
    ("placeholders", "institution_placeholder", r"\[specify\s*institution[^\]]*\]"),
    ("placeholders", "institution_placeholder", r"\[name\s*of\s*institution[^\]]*\]"),
    ("placeholders", "institution_placeholder", r"\[election\s*commission[^\]]*\]"),
    ("placeholders", "party_placeholder", r"\bParty\s+[A-Z]\s*$"),
    ("placeholders", "party_placeholder", r"\bParty\s+[A-Z]\s*[,\.]"),
    ("placeholders", "party_placeholder", r"\bParty\s+[A-Z]\s+Party\s+[A-Z]"),
    ("placeholders", "party_placeholder", r"\[Party\s*[A-Z]\]"),
    ("placeholders", "party_placeholder", r"Party\s+[A-Z]\.{2,}"),
    ("placeholders", "country_specific_placeholder", r"\[country-specific[^\]]*\]"),
    ("placeholders", "coding_instruction_placeholder", r"\[use\s*two-digit\s*code[^\]]*\]"),
    ("placeholders", "fill_in_placeholder", r"\[fill\s*in[^\]]*\]"),
    ("placeholders", "specify_placeholder", r"\[specify[^\]]*\]"),
    ("placeholders", "blank_line_placeholder", "___+"),
    ("placeholders", "empty_parens_placeholder", r"\(\s*\)"),
    ("placeholders", "location_placeholder", r"\[in\s*capital\s*city\]"),
    ("placeholders", "item_placeholder", r"\[ITEM\]"),
    ("placeholders", "item_placeholder", r"\[item\]"),
    ("placeholders", "national_placeholder", r"\(NATIONAL\)"),
    ("placeholders", "national_placeholder", r"\(national\)"),
    ("skip_logic", "skip_instruction", r"[Gg]o\s*to\s*[Qq]\.?\s*\d+"),
    ("skip_logic", "skip_instruction", r"GO\s*TO\s*Q\.?\s*\d+"),
    ("skip_logic", "skip_instruction", r"\[?\s*[Ss]kip\s*to\s*[Qq]\.?\s*\d+\s*\]?"),
    ("skip_logic", "skip_instruction", r"[Gg]o\s*to\s*INTRO"),
    ("skip_logic", "skip_instruction", r"GO\s*TO\s*INTRO"),
    ("skip_logic", "conditional_routing", r"[Ii]f\s*the\s*respondent\s*answers?"),
    ("skip_logic", "conditional_routing", r"IF\s*THE\s*RESPONDENT"),
    ("skip_logic", "logic_check", r"\[?\s*[Ll]ogical\s*check\s*with\s*[Qq]\.?\s*\d+\s*\]?"),
    ("skip_logic", "routing_note", r"[Ff]or\s*those\s*go\s*to"),
    ("response_codes", "code_reference", r"[Cc]ode\s*\d+\s*:"),
    ("response_codes", "code_reference", r"\(\s*[Cc]ode\s*\d+\s*[:\)]"),
    ("response_codes", "code_range", r"[Cc]ode\s*\d+-\d+"),
    ("response_codes", "post_code_instruction", r"\(?\s*[Pp]ost[\s-]*[Cc]ode\s*\)?"),
    ("response_codes", "post_code_instruction", r"\(?\s*POST[\s-]*CODE\s*\)?"),
    ("response_codes", "precoded_instruction", r"open-ended,?\s*pre-coded"),
    ("response_codes", "verbatim_instruction", r"\(?\s*[Rr]ecord\s*[Vv]erbatim[^\)]*\)?"),
    ("scale_abbreviations", "likert_header_abbreviations", r"\bSA\b.*\bSWA\b.*\bSWD\b.*\bSD\b"),
    ("scale_abbreviations", "response_code_abbreviations", r"\bDU\b.*\bCC\b.*\bDA\b"),
    ("scale_abbreviations", "strongly_agree_abbrev", "^SA$"),
    ("scale_abbreviations", "somewhat_agree_abbrev", "^SWA$"),
    ("scale_abbreviations", "somewhat_disagree_abbrev", "^SWD$"),
    ("scale_abbreviations", "strongly_disagree_abbrev", "^SD$"),
    ("scale_abbreviations", "dont_understand_abbrev", "^DU$"),
    ("scale_abbreviations", "cant_choose_abbrev", "^CC$"),
    ("scale_abbreviations", "decline_answer_abbrev", "^DA$"),
    ("scale_abbreviations", "dont_know_abbrev", "^DK$"),
    ("binary_marking", "marked_response", "[Mm]arked"),
    ("binary_marking", "not_marked_response", r"[Nn]ot\s*[Mm]arked"),
    ("binary_marking", "binary_yes_no_codes", "^1$.*^2$"),
    ("binary_marking", "checkbox_response", "[Cc]hecked"),
    ("binary_marking", "checkbox_response", "[Uu]nchecked"),
    ("binary_marking", "checkbox_response", "[Tt]icked"),
    ("multiselect", "sub_question_numbering", r"\d+[a-z]\.\s"),
    ("multiselect", "sub_question_reference", r"[Qq]\d+[a-z]"),
    ("multiselect", "multi_response_first", r"First\s*[Oo]rganization"),
    ("multiselect", "multi_response_second", r"Second\s*[Oo]rganization"),
    ("multiselect", "multi_response_third", r"Third\s*[Oo]rganization"),
    ("administrative", "interview_number", r"[Ii]nterview\s*[Nn]o\.?"),
    ("administrative", "interviewer_id", r"[Ii]nterviewer['’]?s?\s*number"),
    ("administrative", "interview_date", r"[Dd]ate\s*of\s*[Ii]nterview"),
    ("administrative", "postal_code", r"[Pp]ostal\s*[Zz]ip\s*[Cc]ode"),
    ("administrative", "admin_instruction", r"TO\s*BE\s*FILLED\s*IN\s*BY"),
    ("administrative", "admin_instruction", r"[Ff]illed\s*in\s*by\s*the\s*interviewer"),
    ("special_values", "do_not_understand_code", "^97$"),
    ("special_values", "cant_choose_code", "^98$"),
    ("special_values", "decline_to_answer_code", "^99$"),
    ("special_values", "not_applicable_code", "^0$"),
    ("special_values", "dont_understand_single_digit", "^7$"),
    ("special_values", "cant_choose_single_digit", "^8$"),
    ("special_values", "decline_answer_single_digit", "^9$"),
    ("special_values", "special_code_90s", "^9[0-9]$"),
    ("question_quality", "very_short_question", "^.{1,10}$"),
    ("question_quality", "variable_code_only", r"^[A-Z]{2,}\d+$"),
    ("question_quality", "variable_code_only", r"^[A-Z]\d{2,}$"),
    ("question_quality", "answer_reference", r"[Aa]nswer\s*in\s*[Qq]\.?\s*\d+"),
    ("question_quality", "question_reference", r"[Ss]ee\s*[Qq]\.?\s*\d+"),
    ("question_quality", "system_conditional", r"for\s*presidential\s*system"),
    ("question_quality", "system_conditional", r"for\s*parliamentary\s*system"),
    ("missing_data_labels", "dont_know_abbreviation", r"\bDNK\b"),
    ("missing_data_labels", "dont_know_abbreviation", r"\bDK\b"),
    ("missing_data_labels", "dont_know_abbreviation", r"\bDKN\b"),
    ("missing_data_labels", "dont_know_label", r"[Dd]on['’]?t\s*[Kk]now"),
    ("missing_data_labels", "no_answer_abbreviation", r"\bNA\b"),
    ("missing_data_labels", "no_answer_abbreviation", r"\bDNA\b"),
    ("missing_data_labels", "combined_dk_na", r"\bDNK/NA\b"),
    ("missing_data_labels", "combined_dk_na", r"\bDK/NA\b"),
    ("missing_data_labels", "combined_dk_na", r"\bDNK/DNA\b"),
    ("missing_data_labels", "not_applicable_label", r"[Nn]ot\s*[Aa]pplicable"),
    ("missing_data_labels", "no_answer_label", r"[Nn]o\s*[Aa]nswer"),
    ("missing_data_labels", "no_data_label", r"[Nn]o\s*[Dd]ata"),
    ("column_positions", "column_position_single", r"\(\d{1,3}\)$"),
    ("column_positions", "column_position_range", r"\(\d{1,3}-\d{1,3}\)$"),
    ("column_positions", "position_notation", r"\d+-\d+\s*$"),
    ("ranking_questions", "ranking_second", r"[Ww]hich\s*would\s*be\s*second"),
    ("ranking_questions", "ranking_second", r"[Ss]econd\s*most\s*important"),
    ("ranking_questions", "ranking_first", r"[Ff]irst\s*most\s*important"),
    ("ranking_questions", "ranking_third", r"[Tt]hird\s*most\s*important"),
    ("ranking_questions", "sequential_question_number", r"\.\d+\.\s"),
    ("recode_variables", "recode_variable", r"RECODE\s*OF"),
    ("recode_variables", "recode_variable", "RECODED"),
    ("recode_variables", "recode_variable", r"[Rr]ecode\s*of"),
    ("recode_variables", "local_variable", r"LOCAL\s*VARIABLE"),
    ("recode_variables", "weight_variable", r"\bWT\b\.?\s*[Ww]eight"),
    ("survey_series", "standard_question_marker", r"ST(?:GBS)?\."),
    ("survey_series", "global_barometer_marker", r"GBS\."),
    ("survey_series", "world_values_survey_marker", "WVS"),
    ("survey_series", "country_specific_marker", r"CSN?\."),
    ("survey_series", "innovation_module_marker", r"INN?\."),
    ("survey_series", "special_module_marker", r"SDN\."),
]

# Severity by pattern name; other names count as info.
CRITICAL = """
country_placeholder leader_placeholder year_placeholder institution_placeholder party_placeholder country_specific_placeholder fill_in_placeholder
specify_placeholder blank_line_placeholder variable_code_only item_placeholder national_placeholder
""".split()
WARNING = """
showcard_instruction do_not_read interviewer_note instruction_note read_aloud single_answer_instruction multiple_answer_instruction probe_instruction
skip_instruction conditional_routing logic_check code_reference post_code_instruction precoded_instruction verbatim_instruction marked_response
not_marked_response checkbox_response system_conditional answer_reference question_reference location_placeholder coding_instruction_placeholder
coding_only_instruction if_volunteered interviewer_assessment recode_variable local_variable weight_variable
""".split()

# What to do, by pattern name.
SUGGESTIONS = {
    "country_placeholder": "Replace with actual country name for each survey wave",
    "leader_placeholder": 'Replace with actual leader title/name (e.g., "the president" or specific name)',
    "year_placeholder": "Replace with actual election/reference year",
    "institution_placeholder": "Replace with actual institution name",
    "party_placeholder": "Use country-specific party names from survey codebook",
    "fill_in_placeholder": "Remove or replace with appropriate context",
    "blank_line_placeholder": "Remove blank lines or convert to natural language",
    "showcard_instruction": "Remove SHOWCARD reference - not relevant for LLM prompting",
    "do_not_read": "Consider whether these options should be included in LLM prompt",
    "interviewer_note": "Remove interviewer instructions",
    "read_aloud": "Remove read-aloud instructions",
    "probe_instruction": "Remove probe instructions",
    "marked_response": "Convert to Yes/No or actual response labels",
    "not_marked_response": "Convert to Yes/No or actual response labels",
    "checkbox_response": "Convert to meaningful response labels",
    "skip_instruction": "Remove skip logic - not applicable for independent question prompting",
    "conditional_routing": "Document skip conditions separately; remove from question text",
    "code_reference": "Remove code references from question/option text",
    "do_not_understand_code": "Consider whether to include as valid response option",
    "cant_choose_code": "Consider whether to include as valid response option",
    "decline_to_answer_code": "Consider whether to include as valid response option",
}
OTHERWISE = "Review and clean as appropriate"
