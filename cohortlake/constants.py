"""Default column lists and lookup values.

FIXED VALUES: the lists and maps below must equal the reference's own choices for
results to match (categorical columns, dropped columns, renames, the hour-code map,
the Stroop weights and the 127-feature order). They are stated plainly, in the
reference's natural order. Every operator takes them as overridable defaults.
"""

# --- fixed values -----------------------------------------------------------

# Columns never used as model inputs (confounders).
CONFOUNDERS = ["scanner", "scanner_model"]

# Categorical columns filled with the global mode (25).
MODE_FILL_COLUMNS = [
    "site", "sex", "hispanic", "race", "ses_parent_yoe", "cahalan_score",
    "exceeds_bl_drinking_2", "lssaga_dsm4_youth_d04_diag", "lssaga_dsm4_youth_d05_diag",
    "youthreport1_yfhi4", "youthreport1_yfhi3", "youthreport1_yfhi5",
    "youthreport2_chks_set2_chks3", "youthreport2_chks_set2_chks4",
    "youthreport2_chks_set4_chks5", "youthreport2_chks_set4_chks6",
    "youthreport2_chks_set5_chks7", "youthreport2_chks_set5_chks8",
    "youthreport2_chks_set5_chks9", "youthreport2_pwmkcr_involvement_pwmkcr3",
    "youthreport2_shq1", "youthreport2_shq2", "youthreport2_shq3",
    "youthreport2_shq4", "youthreport2_shq5",
]

# String columns turned into integer codes.
CODE_COLUMNS = ["site", "sex", "cahalan_score", "hispanic"]

# Columns expanded by the one-hot operator.
ONE_HOT_COLUMNS = ["site", "sex", "cahalan_score", "hispanic", "race"]

# Label columns whose per-subject mean is rounded up.
LABEL_COLUMNS = ["negative_valence", "arousal", "cognitive", "positive_valence",
                 "no_construct_at_all"]

# Redundant feature columns dropped after the Stroop sums (40).
REDUNDANT_COLUMNS = [
    "youthreport2_rsq_sec1_rsq1", "youthreport2_rsq_sec1_rsq5",
    "youthreport2_rsq_sec2_rsq9", "youthreport2_rsq_sec1_rsq2", "youthreport2_rsq_sec2_rsq12",
    "youthreport2_rsq_sec2_rsq7", "youthreport2_rsq_sec1_rsq3", "youthreport2_rsq_sec1_rsq4",
    "youthreport2_rsq_sec2_rsq10", "youthreport2_rsq_sec1_rsq6", "youthreport2_rsq_sec4_rsq19",
    "youthreport2_rsq_sec4_rsq20", "youthreport2_rsq_sec2_rsq8", "youthreport2_rsq_sec3_rsq17",
    "youthreport2_rsq_sec3_rsq18", "youthreport2_rsq_sec3_rsq13", "youthreport2_rsq_sec3_rsq14",
    "youthreport2_rsq_sec3_rsq15", "np_ehi_lh", "np_ehi_rh", "stroop_conm_rr_error",
    "stroop_conm_rs_error", "stroop_connm_rr_error", "stroop_connm_rs_error",
    "stroop_incm_rr_error", "stroop_incm_rs_error", "stroop_incnm_rr_error",
    "stroop_incnm_rs_error", "stroop_conm_rr_miss", "stroop_conm_rs_miss",
    "stroop_connm_rr_miss", "stroop_connm_rs_miss", "stroop_incm_rr_miss",
    "stroop_incm_rs_miss", "stroop_incnm_rr_miss", "stroop_incnm_rs_miss",
    "stroop_mean_3stdl", "stroop_mean_3stdu", "stroop_total_std", "stroop_total_median",
]

# Construct renames (absent names are ignored).
CONSTRUCT_RENAMES = {
    "ysr_anxdep_t": "negative_valence_anxiety",
    "youthreport1_ysr_section16_ysr103": "negative_valence_sad",
    "youthreport1_ysr_section2_ysr08": "cognitive_concentration",
    "youthreport1_ysr_section13_ysr78": "cognitive_distracted",
    "youthreport1_ysr_section16_ysr100": "arousal_trouble_sleeping",
    "youthreport1_ysr_section8_ysr54": "arousal_overtired",
    "youthreport1_ysr_section1_ysr05": "positive_valence_v2",
}

# Stroop sums as the reference computes them: repeated and omitted terms kept.
STROOP_ERROR_WEIGHTS = {
    "stroop_conm_rr_error": 1, "stroop_conm_rs_error": 1, "stroop_connm_rr_error": 2,
    "stroop_incm_rr_error": 1, "stroop_incm_rs_error": 3,
}
STROOP_MISS_WEIGHTS = {
    "stroop_conm_rr_miss": 1, "stroop_conm_rs_miss": 1, "stroop_connm_rr_miss": 2,
    "stroop_incm_rr_miss": 1, "stroop_incm_rs_miss": 3,
}

# Bedtime (HHMM) to ordinal code: 15:00 .. 24:00 then 00:00 .. 14:30.
HOUR_CODES = {
    1500: 0, 1530: 1, 1600: 2, 1630: 3, 1700: 4, 1730: 5, 1800: 6, 1830: 7, 1900: 8,
    1930: 9, 2000: 10, 2030: 11, 2100: 12, 2130: 13, 2200: 14, 2230: 15, 2300: 16,
    2330: 17, 2400: 18, 0: 19, 30: 20, 100: 21, 130: 22, 200: 23, 230: 24, 300: 25,
    330: 26, 400: 27, 430: 28, 500: 29, 530: 30, 600: 31, 630: 32, 700: 33, 730: 34,
    800: 35, 830: 36, 900: 37, 930: 38, 1000: 39, 1030: 40, 1100: 41, 1130: 42,
    1200: 43, 1230: 44, 1300: 45, 1330: 46, 1400: 47, 1430: 48,
}
HOUR_COLUMNS = ["youthreport2_shq1", "youthreport2_shq2", "youthreport2_shq3",
                "youthreport2_shq4"]

# Feature-category names of the category file.
FEATURE_CATEGORIES = ["demographics", "drug_use", "physical", "life", "personality",
                      "brief", "neuropsych", "sleep"]

TARGET = "depressive_symptoms"
AGE_COLUMN = "visit_age"
SEX_COLUMN = "sex"

# Model-input features, in order (127).
FEATURES = [
    "cesd_score", "sex", "visit_age", "hispanic", "race", "ses_parent_yoe", "pds_score",
    "bmi_zscore", "cahalan_score", "exceeds_bl_drinking_2", "lssaga_dsm4_youth_d04_diag",
    "lssaga_dsm4_youth_d05_diag", "highrisk_yss_extern", "highrisk_yss_intern",
    "highrisk_pss_extern", "highrisk_pss_intern", "youthreport1_yfhi4", "youthreport1_yfhi3",
    "youthreport1_yfhi5", "leq_c_c", "leq_c_cnc", "leq_c_cnu", "leq_c_dau", "leq_c_dcu",
    "leq_c_dnc", "leq_c_dnu", "leq_c_dpc", "leq_c_nc", "leq_c_nu", "leq_c_sn", "leq_c_u",
    "ctq_ea", "ctq_en", "ctq_minds", "ctq_pa", "ctq_pn", "ctq_sa", "aces_total", "tipi_agv",
    "tipi_csv", "tipi_ems", "tipi_etv", "tipi_ope", "upps_nug", "upps_pmt", "upps_psv",
    "upps_pug", "upps_sss", "youthreport2_chks_set2_chks3", "youthreport2_chks_set2_chks4",
    "youthreport2_chks_set4_chks5", "youthreport2_chks_set4_chks6",
    "youthreport2_chks_set5_chks7", "youthreport2_chks_set5_chks8",
    "youthreport2_chks_set5_chks9", "youthreport2_pwmkcr_involvement_pwmkcr3",
    "rsq_problem_solving", "rsq_emotion_expression", "rsq_acceptance",
    "rsq_positive_thinking", "rsq_emotion_regulation", "rsq_cognitive_restructuring",
    "brief_inhibit_t", "brief_beh_shift_t", "brief_cog_shift_t", "cnp_sfnb2_sfnb_tp",
    "cnp_sfnb2_sfnb_fp", "cnp_sfnb2_sfnb_rtc", "cnp_sfnb2_sfnb_tp0", "cnp_sfnb2_sfnb_fp0",
    "cnp_sfnb2_sfnb_rtc0", "cnp_sfnb2_sfnb_tp1", "cnp_sfnb2_sfnb_fp1", "cnp_sfnb2_sfnb_rtc1",
    "cnp_sfnb2_sfnb_tp2", "cnp_sfnb2_sfnb_fp2", "cnp_sfnb2_sfnb_tn0", "cnp_sfnb2_sfnb_tn1",
    "cnp_sfnb2_sfnb_tn2", "cnp_sfnb2_sfnb_fn1", "cnp_sfnb2_sfnb_fn2", "cnp_sfnb2_sfnb_rtc2",
    "cnp_sfnb2_sfnb_mcr", "cnp_sfnb2_sfnb_mrtc", "cnp_sfnb2_sfnb_mrt", "cnp_sfnb2_sfnb_meff",
    "cnp_er40d_er40ang", "cnp_er40d_er40fear", "cnp_er40d_er40hap", "cnp_er40d_er40noe",
    "cnp_er40d_er40sad", "cnp_er40d_er40_fpa", "cnp_er40d_er40_fpf", "cnp_er40d_er40_fph",
    "cnp_er40d_er40_fpn", "cnp_er40d_er40_fps", "cnp_er40d_er40angrt",
    "cnp_er40d_er40fearrt", "cnp_er40d_er40haprt", "cnp_er40d_er40noert",
    "cnp_er40d_er40sadrt", "dd100_logk_1d", "dd100_logk_7d", "dd100_logk_1mo",
    "dd100_logk_6mo", "dd1000_logk_1d", "dd1000_logk_7d", "dd1000_logk_1mo",
    "dd1000_logk_6mo", "np_ehi_result", "stroop_total_mean", "stroop_stroopm_rr_diffrt",
    "stroop_conm_rr_mean", "stroop_incm_rr_mean", "youthreport2_shq1", "youthreport2_shq2",
    "youthreport2_shq3", "youthreport2_shq4", "youthreport2_shq5", "shq_weekday_sleep",
    "shq_weekend_sleep", "shq_weekend_bedtime_delay", "shq_weekend_wakeup_delay",
    "shq_sleepiness", "shq_circadian", "stroop_error_sum", "stroop_miss_sum",
]

# Loss mixes of the two embedding models.
CENTER_MIX = {"bce": 1.0, "center": 0.2}
TRIPLET_MIX = {"bce": 0.45, "center": 0.2, "triplet": 0.35}

BATCH_SIZE = 12
IMAGE_SIZE = 64
SPLIT_SEED = 23

# --- end of fixed values ----------------------------------------------------
