"""chronolake.sources"""
