"""Writers that stage, commit, and can be taken back."""
