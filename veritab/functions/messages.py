"""The texts of the trust log. Check names, message templates and details are reproduced
as given so that logs read the same; ``{...}`` fields are filled with Python format rules."""

# ---- fixed values: statuses ----
INFO, WARNING, CRITICAL = "INFO", "WARNING", "CRITICAL"

# ---- fixed values: (check_name, message template, details template) per outcome ----
SMALL_SAMPLE = ("Small Sample Size", "Dataset has only {n} rows.",
                "Machine learning models require sufficient data to generalize. Results may be unstable or overfitted. "
                "Consider gathering more data or using simpler statistical models.")
SAMPLE_OK = ("Sample Size", "Dataset size is sufficient ({n} rows).",
             "The row count is adequate for running baseline machine learning algorithms.")
EXTREME_MISSING = ("Extreme Missing Data", "Columns {cols} have over 50% missing values.",
                   "Imputing more than 50% of a column introduces significant synthetic bias. "
                   "Consider removing these columns from your features.")
HIGH_MISSING = ("High Missing Data", "Columns {cols} have 20-50% missing values.",
                "These columns contain substantial missing data. The agent will impute them using median/mode, "
                "but this might introduce noise.")
MISSING_OK = ("Missing Data Check", "No features have high missingness (< 20%).",
              "All selected feature columns contain complete or mostly complete data.")
TARGET_MISSING = ("Missing Values in Target",
                  "Target column '{target}' contains {count} missing values ({pct:.1f}%).",
                  "Rows containing missing target values are automatically dropped prior to supervised training.")
LEAKAGE = ("Potential Target Leakage", "Feature '{col}' has a correlation of {r:.3f} with target '{target}'.",
           "An extremely high correlation suggests that this feature contains information about the target that "
           "wouldn't be available at prediction time. Using it will result in an over-optimistic model that fails in "
           "production.")
SUSPICIOUS = ("Suspiciously High Model Score", "Model achieved a score of {score:.4f}.",
              "Perfect or near-perfect performance often indicates target leakage, where a feature directly exposes "
              "the target outcome. Review the selected features.")
SEVERE_IMBALANCE = ("Severe Class Imbalance", "The minority class represents only {pct:.2f}% of the target.",
                    "Severe class imbalance (ratio {ratio:.1f}:1). The model will likely predict the majority class "
                    "('{majority}') for almost all cases. Standard metrics like Accuracy will be misleading; focus on "
                    "F1-Score or Precision/Recall.")
MODERATE_IMBALANCE = ("Moderate Class Imbalance", "The minority class represents {pct:.2f}% of the target.",
                      "Class imbalance ratio is {ratio:.1f}:1. Model baseline might be biased. Stratified split and F1 "
                      "evaluation have been automatically applied.")
BALANCED = ("Class Balance Check", "Classes are reasonably balanced. Minority class is {pct:.1f}%.",
            "Target classes have sufficient representation for standard training and evaluation.")
COLLINEAR = ("Multicollinearity (Feature Redundancy)", "Detected {count} pairs of highly correlated features.",
             "{pairs}. Highly correlated features are redundant and can destabilize linear models or make feature "
             "importance metrics less reliable.")
COLLINEAR_PAIRS = "High correlation found between: "
COLLINEAR_PAIR = "({a} & {b}: r={r:.2f})"
COLLINEAR_OK = ("Multicollinearity Check", "No high correlation detected between numeric features.",
                "All numeric features have low mutual correlations (r < 0.85).")
OVERFIT = ("Overfitting Risk",
           "Training {metric} is {train:.3f} while test score is {test:.3f} (gap = {gap:.3f}).",
           "The model performs substantially better on training data than on unseen test data. This indicates "
           "overfitting. You may need to simplify the model, tune regularisation parameters, or gather more training "
           "samples.")
GENERALIZES = ("Generalization Check", "Training and test scores are close (gap = {gap:.3f}).",
               "The model shows good generalization. Train {metric}: {train:.3f}, Test {metric}: {test:.3f}.")
HIGH_CARDINALITY = ("High Cardinality Categoricals",
                    "Categorical features with very high cardinality detected: {items}.",
                    "One-hot encoding high-cardinality features causes an explosion of feature space (sparsity), which "
                    "degrades performance. The agent will use Ordinal/Label encoding for these, but reducing categories "
                    "or grouping them is recommended.")
HIGH_CARDINALITY_ITEM = "'{col}' ({card} categories)"
WEAK_CLUSTERS = ("Weak Cluster Structure (Low Silhouette Score)",
                 "The best clustering model has a Silhouette Score of {s:.3f}.",
                 "A Silhouette Score below 0.25 indicates that the clusters overlap significantly or that the data lacks "
                 "clear group boundaries. Consider using different features, adjusting the cluster count K, or scaling "
                 "numeric columns.")
STRONG_CLUSTERS = ("Strong Cluster Structure", "Clustering model achieved a Silhouette Score of {s:.3f}.",
                   "A score above 0.50 suggests well-defined, dense, and well-separated data segments.")
MODERATE_CLUSTERS = ("Moderate Cluster Structure", "Clustering model achieved a Silhouette Score of {s:.3f}.",
                     "A score between 0.25 and 0.50 indicates reasonable cluster structure, though boundaries are "
                     "somewhat soft.")
SMALL_CLUSTER = ("Small Cluster Segment", "Cluster {c} contains only {size} rows ({pct:.2f}% of the dataset).",
                 "Clusters representing less than 5% of the data may be capturing noise, anomalies, or very small "
                 "sub-populations. Verify if this segment is actionable for business decisions.")
DOMINANT_CLUSTER = ("Dominated Cluster Size", "Cluster {c} contains {size} rows ({pct:.2f}% of the dataset).",
                    "A single cluster dominates over 80% of the dataset. This indicates that the clustering model did "
                    "not partition the data evenly. Try choosing other features or increasing K.")

# ---- fixed values: metric interpretations for the report metric table ----
METRIC_INTERPRETATION = {
    "Accuracy": "Percentage of correct predictions overall.",
    "F1-Score": "Balanced measure of precision and recall (target score for imbalanced classes).",
    "ROC-AUC": "Ability of the model to distinguish between classes (1.0 is perfect, 0.5 is random).",
    "R²": "Proportion of variance in target explained by features (1.0 is perfect).",
    "RMSE": "Standard deviation of prediction errors (lower is better).",
    "MAE": "Average absolute prediction error (lower is better).",
    "Silhouette Score": "Cohesion & separation of clusters (-1 to 1; higher is better, >0.25 is structured).",
    "Davies-Bouldin Index": "Average similarity between clusters (lower is better, 0.0 is perfect).",
    "Calinski-Harabasz Index": "Ratio of between-cluster variance to within-cluster variance (higher is better).",
    "Inertia (Within Cluster Sum)": "Sum of squared distances of samples to their closest cluster center (lower is better).",
    "BIC (Bayesian Info Criterion)": "Model complexity penalization metric (lower is better).",
}
METRIC_INTERPRETATION_DEFAULT = "Model performance metric."
